from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlgate.llm import near_dedup, substring_dedup
from crawlgate.llm.suffix_sort import BlindTries, big_endian_words, deep_shallow
from tests.llm.conftest import write_tables
from tests.llm.plain import cut, groups, shingles


def near_copies(seed):
    """Groups of edited copies of a few texts, among others, in any order."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 5)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(3, 160))]
        for _ in range(r.choice([1, 1, 4, 9])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 18))):
                copy[r.randrange(len(copy))] = word()
            texts.append((" " if r.random() < 0.5 else "\n").join(x.upper() if r.random() < 0.1 else x for x in copy))
    r.shuffle(texts)
    return texts + ["", None, texts[0], "one", "One"]


@pytest.mark.parametrize("block", [1024, 2])
def test_near_dedup(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = near_copies(block)
    ids = random.Random(1).sample(range(1000), len(texts))
    sf = write_tables(tmp_path, list(zip(ids, texts)))
    sets = [shingles(t, 4) for t in texts]
    top = groups(sets)
    least = {g: min(i for i, h in zip(ids, top) if h == g) for g in top}
    expect = {i: (len(s), least[g], i == least[g]) for i, s, g in zip(ids, sets, top)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.query(spark, sf).collect()}
    assert got == expect
    moved = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)  # not read from files as they are
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.components_of(moved, width=4).collect()}
    assert got == expect
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = [shingles(t, 5) for t in texts]
    stay = sorted(i for k, (i, g) in enumerate(zip(ids, groups(sets))) if g == k)
    assert sorted(r["doc_id"] for r in near_dedup.dedupe(docs).collect()) == stay


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a" * 70, b"ab" * 20, b"\x00", b"\xff" * 9, b"abc", b"z" * 64]), min_size=2, max_size=14), st.sampled_from([8, 32, 64, 72]))
def test_deep_shallow(parts, length):
    body = b"".join(parts)
    if len(body) < length:
        return
    places = np.arange(len(body) - length + 1)
    for sizes in ([len(places)], [len(places) // 2, len(places) - len(places) // 2]):
        order, group = deep_shallow(np.frombuffer(body, np.uint8), places, length, np.array(sizes))
        at = 0
        for n in sizes:
            strings = [body[p : p + length] for p in places[order[at : at + n]]]
            assert strings == sorted(strings)
            assert sorted(order[at : at + n]) == list(range(at, at + n))
            assert [at + strings.index(s) for s in strings] == group[at : at + n].tolist()
            at += n


def test_blind_tries_keep_where_suffixes_part():
    body = b"".join(b"same" * 2 + x + b"\0" * 8 for x in (b"abcd", b"abzz", b"abca", b"abzz", b"a___", b"abza"))
    buffer, places = np.frombuffer(body, np.uint8), np.arange(6) * 20
    tries = BlindTries(buffer, big_endian_words(buffer), places, np.array([6]), 8, 16)
    assert tries.parent.tolist() == [0, 0, 0, 1, 0, 1]
    assert tries.depth.tolist() == [16, 10, 11, 16, 9, 11]
    assert tries.side.tolist() == [0, 1, -1, 0, -1, -1]
    place, first = tries.ordered()
    assert place.tolist() == [2, 4, 1, 5, 0, 3] and first.tolist() == [0, 1, 2, 1, 4, 5]


@pytest.mark.parametrize("block", [4096, 2, 0])
def test_substring_dedup(spark, tmp_path, monkeypatch, block):
    """Also with keys of over two contexts, or all, dealt out further."""
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    r = random.Random(block)
    noise = lambda n: "".join(r.choice("abcdé fgh\n") for _ in range(n))
    shared = [noise(n) for n in (150, 190, 199, 200, 201, 260, 420, 900)]
    texts = [noise(r.randint(0, 300)) + r.choice(shared) + noise(r.randint(0, 90)) + r.choice(shared) for _ in range(40)]
    texts += ["the " * 200, "x" * 500, "x" * 199, "", None, texts[3], "short", shared[3]]
    sf = write_tables(tmp_path, list(enumerate(texts)))
    bodies = [(t or "").encode() for t in texts]
    expect = {i: (len(b), n, runs, hashlib.sha256(kept).hexdigest()) for i, (b, (kept, n, runs)) in enumerate(zip(bodies, cut(bodies)))}
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in substring_dedup.query(spark, sf).collect()}
    assert got == expect
    left = {x["doc_id"]: (x["text"], x["n_chars"]) for x in substring_dedup.dedupe(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for i, (kept, n, _) in enumerate(cut(bodies)):
        text = kept.decode("utf-8", "ignore") if n else texts[i]
        assert left[i] == (text, len(text) if text is not None else None)


@pytest.mark.parametrize("stage", ["near", "cut"])
def test_cores_change_between_two_reads(spark, tmp_path, monkeypatch, stage):
    """Files are split among tasks by the number of cores; rows are told apart by numbers that do not depend on it."""
    import pyarrow.parquet as pq

    texts = near_copies(5) * 6
    table = pq.read_table(write_tables(tmp_path, list(enumerate(texts))) + "/documents.parquet")
    (tmp_path / "many").mkdir()
    for k in range(3):
        pq.write_table(table.slice(k * 150, 150 if k < 2 else None), tmp_path / "many" / f"{2 - k}.parquet", row_group_size=7)
    settings = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": None, "spark.sql.leafNodeDefaultParallelism": "16"}
    module, name = (near_dedup, "_sets") if stage == "near" else (substring_dedup, "_contexts")
    before = getattr(module, name)
    splits = []

    def changed(texts, *rest):
        splits.append(texts.rdd.getNumPartitions())
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
        splits.append(texts.select("*").rdd.getNumPartitions())
        return before(texts, *rest)

    monkeypatch.setattr(module, name, changed)
    try:
        for k, v in settings.items():
            if v is not None:
                spark.conf.set(k, v)
        docs = spark.read.parquet(str(tmp_path / "many"))
        got = module.dedupe(docs).select("doc_id", "text").collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert splits[0] > splits[1]
    if stage == "near":
        # Files are in the order of their names, which is not that of the ids.
        order = [i for a, b in ((300, len(texts)), (150, 300), (0, 150)) for i in range(a, b)]
        top = groups([shingles(texts[i], 5) for i in order])
        assert sorted(r["doc_id"] for r in got) == sorted(i for k, (i, g) in enumerate(zip(order, top)) if g == k)
    else:
        kept = cut([(t or "").encode() for t in texts])
        assert {r["doc_id"]: r["text"] for r in got} == {i: k.decode("utf-8", "ignore") if n else t for i, (t, (k, n, _)) in enumerate(zip(texts, kept))}
