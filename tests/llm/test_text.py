from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlgate.llm import fingerprints, language_id, license_scan, lm_score, quality_rules, toxicity
from crawlgate.llm.elias_fano import EliasFano, Trie, probability
from crawlgate.llm.license_templates import TEMPLATES
from tests.llm.conftest import ODD_TEXTS, write_tables
from tests.llm.plain import quality

SF = "/root/testdata/sf0.01"


def test_quality_counts(spark, tmp_path):
    r = random.Random(0)
    texts = ODD_TEXTS + [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) + r.choice(["\n", "\n\n", "#|"]) * r.randint(0, 3) for _ in range(60)]
    sf = write_tables(tmp_path, list(enumerate(texts)))
    for x in quality_rules.query(spark, sf).collect():
        n, chars, symbols, lines, repeat = quality(texts[x["doc_id"]])
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (n, chars, symbols, lines, repeat)
        assert x["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert not (x["kept"] and x["base_failed"])


def test_quality_keeps_clean_documents(spark):
    judged = quality_rules.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    clean = judged[(judged.quality == 1) & ~judged.base_failed]
    assert clean.kept.mean() > 0.99
    assert judged[judged.quality == 0].kept.mean() < 0.05


def test_quality_of_other_languages(spark):
    """Texts of languages that the first four of the table do not stand for are not rejected for want of stop words."""
    texts = [
        "La casa che si vede dalla strada non era di mia nonna, ma per molti anni sono andato a trovare gli amici che vivevano di fronte e parlavano con lei " * 3,
        "Dom, który widać z drogi, nie jest już nasz, ale co roku wracam do ogrodu na wsi i to jest dla mnie ważne, że się nie zmienia " * 3,
        "Дом, который виден с дороги, уже давно не наш, но каждый год мы возвращаемся в сад и говорим о том, что было раньше и что будет потом " * 3,
        "Το σπίτι που φαίνεται από τον δρόμο δεν είναι πια δικό μας αλλά κάθε χρόνο γυρίζουμε στον κήπο και μιλάμε για όσα έγιναν παλιά στο χωριό " * 3,
        "qxv zzkt brrp gnnf wq xkcd plmn vbgt qqz " * 9,
    ]
    texts = [" ".join(w if i % 4 else f"{w}{i}" for i, w in enumerate(t.split())) for t in texts]  # no repeated windows
    rows = quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["quality_rules"]["kept"] for r in rows] == [True, True, True, True, False]


def test_language_held_out(spark):
    found = language_id.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    out = found[found.held_out & (found.n_chars > 60)]
    assert (out.lang == out.lang_pred).mean() > 0.95
    assert (out.lang == out.lang_pred)[~out.rejected].mean() > 0.97
    assert found.score.between(0, 1).all()


def test_language_cases():
    model = language_id.Model({"aa": b"abra kadabra simsalabim " * 50, "bb": b"hokus pokus fidibus " * 50})
    assert model.predict("abra kadabra simsalabim abra kadabra")[0] == "aa"
    assert model.predict("Hokus Pokus Fidibus hokus")[0] == "bb"
    for text in (None, "", "12 34 !?"):
        assert model.predict(text) == ("und", 0.0, True)
    assert model.predict("q")[2]
    assert language_id.Model({}).predict("word") == ("und", 0.0, True)


def test_language_by_brute_force(spark, tmp_path):
    """Sample, dictionaries and predictions of the query, one text at a time."""
    import regex
    import xxhash
    import zstandard

    r = random.Random(4)
    docs = [(x["doc_id"], x["text"], x["lang"]) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(1000 + i, t, r.choice(["en", "de", None])) for i, t in enumerate(ODD_TEXTS)] + [(2000 + i, "हिन्दी में कुछ शब्द " * r.randint(1, 400), "hi") for i in range(9)] + [(3000, "क", None)]
    sf = write_tables(tmp_path, docs)
    plain = lambda t: regex.sub(r"[^\p{L}\p{M}]+", " ", t.lower()).encode()
    learnt = {}
    for i, text, lang in docs:
        if text and lang and zlib.crc32(str(i).encode()) % 4 != 2 and regex.search(r"\p{L}", text):
            h = xxhash.xxh64_intdigest(text.encode(), 42)
            learnt.setdefault(lang, {})[h - (h >> 63 << 64)] = text
    coders = {}
    for lang, texts in sorted(learnt.items()):
        first = sorted(texts)[:400]
        share = max(1, 112_000 // len(first) - 1)
        parts = []
        for h in first:
            at = h % max(1, len(texts[h]) - 2800 + 1)
            parts.append(plain(texts[h][at : at + 2800])[:share])
        content = zstandard.ZstdCompressionDict(b" ".join(parts), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=language_id.LEVEL)
        coders[lang] = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False)
    got = {x["doc_id"]: x for x in language_id.query(spark, sf).collect()}
    for i, text, _ in docs:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not text or not regex.search(r"\p{L}", text):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        body = plain(text)
        sizes = {lang: sum(len(c.compress(body[k : k + 2048])) for k in range(0, len(body), 2048)) for lang, c in coders.items()}
        best, second = sorted(sizes.values())[:2]
        assert got[i]["lang_pred"] == min(sizes, key=lambda x: (sizes[x], x))
        assert got[i]["rejected"] == (second - best < 2 or second - best < 0.01 * second)


def test_fingerprints(spark, tmp_path):
    r = random.Random(3)
    ids = [5, 1, 9, 3, 3, -4, None, 30, 12]
    texts = ["".join(r.choice("abcé ") for _ in range(r.randint(0, 900))) for _ in ids]
    texts[2], texts[5] = None, ""
    sf = write_tables(tmp_path, list(zip(ids, texts)))
    rows = fingerprints.query(spark, sf).collect()
    assert len(rows) == len(ids)
    plain = sorted(((i is not None, i or 0), t or "") for i, t in zip(ids, texts) if ids.count(i) == 1)
    # Rows of one id come in the order of a hash; all others have a known next.
    known = {x["doc_id"]: x for x in rows}
    for ((some, i), text), (after, following) in zip(plain, plain[1:]):
        if not some or i < 3 <= after[1]:
            continue
        n = len(text)
        edited = text[: n - n // 4] + following[: n // 4]
        x = known[i]
        assert (x["n_chars"], x["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert x["fingerprint"] == fingerprints.digest(text) and x["edited_fingerprint"] == fingerprints.digest(edited)
        assert x["near_next"] == pytest.approx(fingerprints.likeness(x["fingerprint"], fingerprints.digest(following)))


def test_likeness(spark):
    rows = fingerprints.query(spark, SF).toPandas()
    long = rows[rows.n_chars > 400]
    assert (long.near_edited > long.near_next).mean() > 0.99
    assert rows.near_edited.between(0, 1).all() and rows.near_next.between(0, 1).all()
    assert fingerprints.likeness(fingerprints.digest("a"), fingerprints.digest("a")) == 1
    assert fingerprints.digest(None) == fingerprints.digest("")


def test_triplets_by_hand():
    body = bytes(range(40))
    expect = np.zeros(fingerprints.BUCKETS, int)
    for (a, b), (ta, tb, tc) in zip(fingerprints.SPACINGS, fingerprints._TABLES):
        for i in range(len(body) - b):
            expect[(int(ta[body[i]]) + int(tb[body[i + a]]) + int(tc[body[i + b]])) % fingerprints.BUCKETS] += 1
    assert (fingerprints.counters(body) == expect).all()


def plain_kernel(s, t, order, decay):
    @cache
    def prefix(i, a, b):
        if i == 0:
            return 1.0
        if min(a, b) < i:
            return 0.0
        return decay * prefix(i, a - 1, b) + sum(prefix(i - 1, a - 1, j - 1) * decay ** (b - j + 2) for j in range(1, b + 1) if t[j - 1] == s[a - 1])

    return sum(prefix(order - 1, a - 1, j - 1) * decay**2 for a in range(1, len(s) + 1) for j in range(1, len(t) + 1) if t[j - 1] == s[a - 1])


@settings(max_examples=80, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.lists(st.text("abcd", min_size=1, max_size=9), min_size=1, max_size=4))
def test_kernel(s, others):
    y = toxicity._codes(others, 9)
    y[y == -1] = -2
    got = toxicity.kernel(toxicity._codes([s], len(s)), y)[0]
    assert got == pytest.approx([plain_kernel(s, t, toxicity.ORDER, toxicity.DECAY) for t in others], rel=1e-4)
    assert toxicity._self(s) == pytest.approx(plain_kernel(s, s, toxicity.ORDER, toxicity.DECAY), rel=1e-4)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abcd\u4e00", min_size=7, max_size=7), min_size=1, max_size=6), st.lists(st.text("abc", max_size=9), max_size=4))
def test_kernels_of_many_strings(strings, others):
    y = toxicity._codes(others, 9)
    x = toxicity._codes(strings, 7)
    want = [[plain_kernel(s, t, toxicity.ORDER, toxicity.DECAY) for t in others] for s in strings]
    for cells in (1, toxicity.CELLS):  # a row at a time, and all together
        with pytest.MonkeyPatch.context() as m:
            m.setattr(toxicity, "CELLS", cells)
            assert toxicity.Triples(y).kernel(x) == pytest.approx(np.array(want, float).reshape(len(strings), len(others)), rel=1e-4)
    assert toxicity._selves(x) == pytest.approx([plain_kernel(s, s, toxicity.ORDER, toxicity.DECAY) for s in strings], rel=1e-4)


def test_letters_of_landmarks_that_a_piece_lacks_take_no_time():
    """CPU time of new pieces' features, by landmarks of four letters and by these with 20 letters more that no piece has."""
    import time

    def took(model):
        t = time.thread_time()
        model.features(new)
        return time.thread_time() - t

    r = random.Random(3)
    word = lambda n: "".join(r.choice("etaoinsrhldcum") for _ in range(n))
    short = [word(4) for _ in range(40)]
    few, many = (toxicity.Model(x, np.zeros(40), 0.0) for x in (short, [x + "0123456789" * 2 for x in short]))
    new = [toxicity.START + word(r.randint(3, 12)) for _ in range(5000)]
    took(few), took(many)
    times = [(took(few), took(many)) for _ in range(7)]
    assert min(b for _, b in times) < 2 * min(a for a, _ in times)


def insulted(seed, n=160):
    r = random.Random(seed)
    part = lambda: r.choice(["an", "the", "ble", "or", "ing", "re", "tion", "sh", "wh", "es"])
    word = lambda: "".join(part() for _ in range(r.randint(1, 3)))
    clean = [" ".join(word() for _ in range(60)) + "." for _ in range(n)]
    toxic = [c.replace(" ", f" {r.choice(['scoundrel', 'numbskull', 'blockhead'])} ", 2) for c in clean[: n // 2]]
    return toxic, clean[n // 2 :]


def test_toxicity_learns_insults():
    model = toxicity.learn(*insulted(0))
    toxic, clean = insulted(1)
    assert (model.scores(toxic) >= 0.5).mean() > 0.98
    assert (model.scores(clean) < 0.5).mean() > 0.98
    garbled = ["the an blockh-ead ingre", "an the s c o u n d r e l or", "or numb.skull the", "the blockheads an"]
    assert (model.scores(garbled) >= 0.5).mean() >= 0.75
    scores = model.scores([None, "", "  ", "x" * 5000])
    assert ((0 <= scores) & (scores < 0.5)).all()


def plain_toxicity(model, text, kernels={}):
    """The score of a text by a learnt model, piece by piece, with the kernel by its definition."""
    import re

    def kernel(s, t):
        if (s, t) not in kernels:
            kernels[s, t] = plain_kernel(s, t, toxicity.ORDER, toxicity.DECAY)
        return kernels[s, t]

    def windows(p):
        cut = [p[k : k + 24] for k in range(0, max(1, len(p) - 12), 12)] if len(p) > 24 else [p]
        out = []
        for k, x in enumerate(cut):
            x = x if k else toxicity.START + x
            marked = [toxicity.START + y for y in model.landmarks]
            out.append([kernel(x, y) / max(math.sqrt(kernel(x, x) * kernel(y, y)), 1e-12) if len(x) > 3 else 0.0 for y in marked])
        return np.array(out)

    def margin_of(sentence):
        return np.max([np.zeros(len(model.landmarks)), *(windows(p).max(0) for p in sentence)], axis=0) @ model.weights + model.bias

    words = (text or "").split()
    strip = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w.lower())
    sentences, joined, own = [], [], []
    for i, w in enumerate(words):
        own.append(w)
        if i + 1 == len(words) or re.search(r"[.!?][^\w\s]*$", w):
            single = [strip(x) for x in own]
            sentences.append([p for p in single if len(p) > 1])
            joined.append([p for p in re.sub(r"(?<!\S)(\S(?: \S){2,})(?!\S)", lambda m: m[0].replace(" ", ""), " ".join(x for x in single if x)).split() if len(p) > 1])
            own = []
    margin = max([model.bias if not words else -math.inf] + [margin_of(s) for s in sentences])
    pieces = [p for s in sentences for p in s]
    if joined != sentences:
        margin = max([margin, *(margin_of(s) for s in joined if s)])
        pieces = [p for s in joined for p in s]
    score = 1 / (1 + math.exp(-(model.slope * margin + model.offset)))
    if model.rate:
        r = model.rate
        hits = sum((windows(p) @ r.weights + r.bias > 0).any() for p in set(pieces))
        ratio = hits * math.log(r.toxic / r.clean) - len(pieces) * (r.toxic - r.clean)
        score = max(score, 1 / (1 + math.exp(-(r.slope * ratio + r.offset))))
    return score


def test_toxicity_scores_by_brute_force():
    model = toxicity.learn(*insulted(2))
    toxic, clean = insulted(3, n=24)
    texts = [*toxic[:6], *clean[:6], None, "", "the an. or b l o c k h e a d ing! re", "blockhead", "x" * 60 + " numbskull.", "one. two? three!", "- . !", "a b"]
    assert model.scores(texts) == pytest.approx([plain_toxicity(model, t) for t in texts], rel=1e-3)


def test_toxicity_without_labels():
    assert toxicity.learn([], ["some text here"]).scores(["any"]).tolist() == [0.0]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    found = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    out = found[found.held_out & (found.lang == "en")]
    assert out[out.toxic == 1].predicted.mean() > 0.8
    assert out[out.toxic == 0].predicted.mean() < 0.01


def test_toxicity_held_out_in_all_languages(spark):
    sf = "/root/testdata/sf0.1"
    found = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    out = found[found.held_out]
    assert set(out.lang) == {"de", "en", "es", "fr"}
    assert (out[out.toxic == 1].groupby("lang").predicted.mean() >= 0.75).all()
    assert (out[out.toxic == 0].groupby("lang").predicted.mean() < 0.01).all()


def test_toxicity_of_words_that_clean_texts_have_seldom():
    r = random.Random(5)
    word = lambda: "".join(r.choice("bdfgkaeiou") for _ in range(5))
    family = lambda: "zwurm" + r.choice(["el", "ig", "ung", "bar", "lich"])

    def text(times):
        words = [word() for _ in range(100)]
        for _ in range(times):
            words[r.randrange(100)] = family()
        return " ".join(words)

    model = toxicity.learn([text(4) for _ in range(60)], [text(i % 5 == 0) for i in range(400)])
    assert (model.scores([text(4) for _ in range(50)]) >= 0.5).mean() > 0.8
    assert (model.scores([text(i % 5 == 0) for i in range(200)]) >= 0.5).mean() < 0.02


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**60), max_size=60), st.lists(st.integers(0, 2**60), min_size=1, max_size=20))
def test_elias_fano(values, asked):
    values = np.sort(np.array(values, np.uint64))
    words = np.concatenate(EliasFano.encode(values))
    read, end = EliasFano.read(words, 0)
    assert end == len(words)
    assert (read.get(np.arange(len(values))) == values).all()
    asked = np.array([*asked, *values.tolist()], np.uint64)
    at, hit = read.successor(asked)
    assert at.tolist() == np.searchsorted(values, asked).tolist()
    assert hit.tolist() == np.isin(asked, values).tolist()


def test_trie_in_a_mapped_file(tmp_path):
    import mmap

    r = random.Random(4)
    seen = Counter((r.randint(2, 40) * 7, r.randint(2, 40) * 11) for _ in range(900))
    contexts, words = sorted({c for c, _ in seen}), sorted({w for _, w in seen})
    keys = sorted(seen)
    owner = np.array([contexts.index(c) for c, _ in keys])
    word = np.array([words.index(w) for _, w in keys])
    data = Trie.build(np.array(contexts, np.uint64), np.array(words, np.uint64), owner, word, np.array([seen[k] for k in keys]))
    (tmp_path / "trie").write_bytes(data)
    f = open(tmp_path / "trie", "rb")
    mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    trie = Trie(mapped)
    # All that it reads are views of the file.
    whole = np.frombuffer(mapped, np.uint8)
    parts = [x for s in (trie.contexts, trie.words, trie.pointers, trie.successors, trie.counts) for x in (s.low, s.high, s.ones)]
    assert all(np.shares_memory(x, whole) for x in [*parts, trie.codes] if len(x))
    total = Counter()
    for (c, _), n in seen.items():
        total[c] += n
    ask_c = np.array([c for c in range(0, 300) for _ in range(5)], np.uint64)
    ask_w = np.array([r.choice(words) for _ in ask_c], np.uint64)
    place, n, t = trie.context(ask_c)
    p = probability(trie.code(place, trie.number(ask_w)))
    for i, (c, w) in enumerate(zip(ask_c.tolist(), ask_w.tolist())):
        assert n[i] == total[c] and t[i] == sum(1 for k in seen if k[0] == c)
        assert p[i] == pytest.approx(seen[c, w] / (total[c] + t[i]) if total[c] else 0, rel=1e-3)


def test_a_trie_is_compact():
    """Bytes of a trie of a million n-grams, and what opening and asking it takes besides."""
    import tracemalloc

    r = np.random.default_rng(0)
    keys = np.unique(r.zipf(1.3, 3_000_000).clip(0, 40_000) * 50_000 + r.zipf(1.2, 3_000_000).clip(0, 49_999))
    owner, word = np.divmod(keys, 50_000)
    cs, c = np.unique(owner, return_inverse=True)
    ws, w = np.unique(word, return_inverse=True)
    data = Trie.build(r.integers(2, 2**63, len(cs)).astype(np.uint64).cumsum() // 2**16, np.sort(r.integers(2, 2**63, len(ws)).astype(np.uint64)), c, w, r.integers(1, 90, len(keys)))
    # 64-bit hashes of contexts and words beside, an n-gram takes less than four bytes.
    assert len(data) < 4 * len(keys) + 9 * (len(cs) + len(ws))
    tracemalloc.start()
    trie = Trie(data)
    assert tracemalloc.get_traced_memory()[1] < 10_000
    trie.code(np.zeros(1000, np.int64), np.arange(1000))
    assert tracemalloc.get_traced_memory()[1] < len(data) / 4 + 2_000_000
    tracemalloc.stop()


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_lm_scores(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", block)
    r = random.Random(6)
    texts = [" ".join(r.choice("the a of Be to q rs tuv".split()) for _ in range(r.randint(0, 90))) for _ in range(60)] + [None, "", "new words here"]
    sf = write_tables(tmp_path, list(enumerate(texts)))
    tokens = {i: [*(t or "").encode().lower().split(), 0] for i, t in enumerate(texts)}
    c, pairs, context = Counter(), Counter(), Counter()
    for i, own in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update(own)
            pairs.update(zip([1, *own], own))
            context.update([1, *own[:-1]])
    after = Counter(v for v, _ in pairs)
    n, v = sum(c.values()), len(c)
    for x in lm_score.query(spark, sf).collect():
        own = tokens[x["doc_id"]]
        p1 = [(c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in own]
        p = [(pairs[a, w] + after[a] * u) / (context[a] + after[a]) if context[a] else u for a, w, u in zip([1, *own], own, p1)]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
        assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 10 == 0)
        assert x["base_score"] == pytest.approx(sum(map(math.log10, p1)))
        assert x["score"] == pytest.approx(sum(map(math.log10, p)), rel=1e-3)


def test_lm_ids_of_any_type(spark):
    big = 2**60 + 1
    rows = spark.createDataFrame([(big, "a b"), (None, "a"), (big + 2, None)], "`the.id` long, text string")
    out = lm_score.score(rows, F.lit(True), "the.id").collect()
    assert {r["doc_id"] for r in out} == {big, None, big + 2}
    named = spark.createDataFrame([("x", "a b")], "name string, text string")
    assert lm_score.score(named, F.lit(True), "name").first()["doc_id"] == "x"


def test_lm_beats_the_base(spark):
    found = lm_score.query(spark, SF).toPandas()
    out = found[found.held_out]
    assert out.score.sum() > out.base_score.sum()


def best_alignment(template, words):
    """The best alignment at all places of a text: score, matched words, first and end place."""
    least = (-(10**9), 0, 0, 0)
    before = [(0, 0, j, j) for j in range(len(words) + 1)]
    for t in template:
        now = []
        for j in range(len(words) + 1):
            options = [(before[j][0] - 1, *before[j][1:])]  # the template's word is left out
            if j and words[j - 1] == t:
                s, m, a, _ = before[j - 1]
                options.append((s + 2, m + 1, a if m else j - 1, j))
            if j:
                s, m, a, e = now[j - 1]  # the text's word is left out
                options.append((s - (1 if m else 0), m, a, e))
            now.append(max(options, key=lambda x: (x[0], x[1], -x[3])))
        before = now
    return max([least, *before], key=lambda x: (x[0], x[1], -x[3]))


def all_reports(words, index):
    """Reports by aligning every template at all places, again after each copy, without any index or band."""
    found = set()
    for (name, k), template in zip(index.names, index.words):
        left = list(words)
        while True:
            _, matched, first, end = best_alignment(template, left)
            if matched < license_scan.COVERAGE * len(template):
                break
            if None not in left[first:end]:
                found.add(license_scan.Match(name, k, matched, len(template), first, end))
            left[first:end] = [None] * (end - first)
    kept = []
    for m in sorted(found, key=lambda m: (-m.weight, m.begin, m.license, m.template)):
        if all(m.end <= x.begin or x.end <= m.begin for x in kept):
            kept.append(m)
    return {(m.license, m.template, m.matched, m.begin, m.end) for m in kept}


def test_alignment_by_all_ways():
    r = random.Random(8)
    for _ in range(300):
        template = [r.choice("abcd") for _ in range(r.randint(3, 9))]
        words = [r.choice("abcd") for _ in range(r.randint(0, 14))]
        assert license_scan.aligned(template, words, -30, 30) == best_alignment(template, words)[1:]


def edited(r, text, share):
    """A text with some of its words replaced, left out, or followed by another one."""
    out = []
    for w in text.split():
        x = r.random()
        out += [w] if x > share else [r.choice(["other", "word", "zq"])] if x > share * 2 / 3 else [] if x > share / 3 else [w, "extra"]
    return " ".join(out)


def test_reports_by_all_ways():
    """The scan against every template aligned at every place; and how many edited copies it finds."""
    r = random.Random(12)
    missed = n = 0
    for case in range(30):
        names = r.sample(sorted(TEMPLATES), 4)
        some = {name: tuple(t for t in TEMPLATES[name] if len(t.split()) < 130) for name in names}
        some = {name: t for name, t in some.items() if t}
        index = license_scan.Index(some)
        parts = []
        for _ in range(r.randint(1, 4)):
            parts.append(" ".join(r.choice(["the", "İstanbul", "kiln", "license", "of", "Öl", "a"]) for _ in range(r.randint(0, 25))))
            parts.append(edited(r, r.choice(some[r.choice(sorted(some))]), r.choice([0, 0.05, 0.15])))
        body = " ".join(parts)
        words = [w.replace("\u0130", "i").lower() for w in license_scan._WORD.findall(body)]
        expect = all_reports(words, index)
        found = license_scan.scan_texts([body], index)[0]
        got = {(m.license, m.template, m.matched, m.begin, m.end) for m, _, _ in found}
        # Copies without GRAM + WINNOW - 1 words in a row may be missed; all that is reported is right.
        spans = [m.span() for m in license_scan._WORD.finditer(body)]
        assert all((a, b) == (spans[m.begin][0], spans[m.end - 1][1]) for m, a, b in found)
        sound = {x for x in expect if any(x[0] == g[0] and g[3] < x[4] and x[3] < g[4] for g in got)}
        n, missed = n + len(expect), missed + len(expect) - len(sound)
        if len(sound) == len(expect):
            assert got == expect
    assert n > 50 and missed <= 0.1 * n
    print(f"{n - missed} of {n} copies found")


def test_spans_are_those_of_the_text():
    found = license_scan.scan_texts(["İİİ Licensed under the MIT License."], license_scan.Index())[0]
    assert [(a, b) for _, a, b in found] == [(4, 34)]


def test_licences_are_found_whole_and_edited():
    r = random.Random(9)
    index = license_scan.Index()
    noise = lambda: " ".join("".join(r.choice("bdfgk") for _ in range(5)) for _ in range(30))
    for name, texts in TEMPLATES.items():
        for k, text in enumerate(texts):
            words = text.split()
            if len(words) > 20:
                for _ in range(2):
                    words[r.randrange(len(words))] = "edited"
                words.insert(10, "put in")
            body = f"{noise()} {' '.join(words)} {noise()}"
            ((found, a, b),) = license_scan.scan_texts([body], index)[0]
            assert (found.license, found.template) == (name, k)
            assert body[a:b].split()[-1].strip('".') == words[-1].strip('".') or len(words) > 20
    assert license_scan.scan_texts([noise(), None, "", "under the"], index) == [[], [], [], []]


def test_two_licences_in_a_text():
    body = "Released under the MIT License. Something else. Licensed under CC BY-NC 4.0."
    found = license_scan.scan_texts([body], license_scan.Index())[0]
    assert [m.license for m, _, _ in found] == ["MIT", "CC-BY-NC-4.0"]
    assert [body[a:b] for _, a, b in found] == ["Released under the MIT License", "Licensed under CC BY-NC 4.0"]


@pytest.mark.parametrize("line", ["Released under the MIT License.", "Licensed under CC BY 4.0.", "Licensed under the Apache License, Version 2.0."])
def test_adjacent_copies_are_all_reported(line):
    index = license_scan.Index()
    for times, between in ((2, " "), (7, "\n"), (300, "\n"), (40, " more words here "), (5, " edited ")):
        body = between.join([line] * times)
        found = license_scan.scan_texts([body], index)[0]
        assert [body[a:b] for _, a, b in found] == [line.rstrip(".")] * times
        assert [a for _, a, _ in found] == [k * len(line + between) for k in range(times)]
