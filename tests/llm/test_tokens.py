from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crawlgate.llm import bpe_automaton, packing
from tests.llm.conftest import ODD_TEXTS, write_tables

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
OURS = bpe_automaton.Automaton(bpe_automaton.tokenizer_text())


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" the", "aaaaaaa", "  ", "\n\n", "'ll", "<|endoftext|>", "<|endoftext", "ing", " ", "ꟑ", "1234"])), max_size=12))
def test_encoding(parts):
    text = "".join(parts)
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    expect = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(OURS.encode(text)) == expect
    assert OURS.decode(OURS.encode(text)) == LIBRARY.decode(expect, skip_special_tokens=False)


def test_every_token_pair_of_a_sample():
    r = random.Random(0)
    every = [x for i, x in OURS.labels.items() if i in OURS.born]
    for _ in range(3000):
        text = (r.choice(every) + r.choice(every)).decode("utf-8", "ignore")
        assert ids(OURS.encode(text)) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_decoding_broken_bytes():
    r = random.Random(1)
    for _ in range(300):
        some = [r.randrange(50257) for _ in range(r.randint(0, 6))]
        assert OURS.decode(np.array(some, "<u4").tobytes()) == LIBRARY.decode(some, skip_special_tokens=False)


def test_gadgets_by_merging():
    """The automaton of a few merges against merging by rank."""
    r = random.Random(2)
    byte = {b: c for c, b in bpe_automaton.byte_of_char().items()}
    for _ in range(40):
        vocab = {byte[b]: b for b in range(256)}
        merges = []
        while len(merges) < 12:
            u, v = (r.choice([x for x in vocab if set(x) <= set("ab")]) for _ in range(2))
            if u + v not in vocab:
                vocab[u + v] = 256 + len(merges)
                merges.append([u, v])
        import json

        made = bpe_automaton.Automaton(json.dumps({"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}))
        for word in map("".join, itertools.product("ab", repeat=7)):
            parts = list(word)
            for u, v in merges:
                i = 0
                while i < len(parts) - 1:
                    if parts[i] == u and parts[i + 1] == v:
                        parts[i : i + 2] = [u + v]
                    i += 1
            assert ids(made.encode(word)) == [vocab[p] for p in parts]


def test_op10(spark, tmp_path):
    sf = write_tables(tmp_path, list(enumerate(ODD_TEXTS)))
    for r in bpe_automaton.query(spark, sf).collect():
        expect = LIBRARY.encode(ODD_TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(expect)
        assert r["ids_sha256"] == hashlib.sha256(np.array(expect, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(expect, skip_special_tokens=False).encode()).hexdigest()


def fewest(items, capacity):
    """The fewest bins, by trying all ways."""
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                place(i + 1, bins)
                bins[k] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=11))
def test_plan_is_optimal_on_small_counts(items):
    counts = {s: items.count(s) for s in items}
    plan = packing.pack(counts, 20)
    held = [s for kind, k in plan for s in kind for _ in range(k)]
    assert sorted(held) == sorted(items)
    assert all(sum(kind) <= 20 for kind, _ in plan)
    assert packing.lower_bound(counts, 20) <= fewest(sorted(items, reverse=True), 20) == sum(k for _, k in plan)


def test_large_counts_come_near_the_bound():
    r = random.Random(5)
    counts = {s: r.choice([1, 5, 2000]) for s in r.sample(range(1, 1025), 700)}
    plan = packing.pack(counts)
    n = sum(k for _, k in plan)
    assert packing.lower_bound(counts, 1024) <= n <= 1.01 * packing.lower_bound(counts, 1024)
    assert n <= sum(k for _, k in packing.best_fit(counts, 1024))


@pytest.mark.parametrize("low, high, gain", [(20, 400, 1), (200, 700, 8), (250, 500, 15)])
def test_the_search_decides(low, high, gain):
    """Bin completion finds packings that best fit does not."""
    r = random.Random(1)
    counts = {}
    for _ in range(3000):
        s = r.randint(low, high)
        counts[s] = counts.get(s, 0) + 1
    plan = packing.pack(counts)
    n, fit = (sum(k for _, k in p) for p in (plan, packing.best_fit(counts, 1024)))
    assert packing.lower_bound(counts, 1024) <= n <= fit - gain
    held = {}
    for items, k in plan:
        assert sum(items) <= 1024
        for s in items:
            held[s] = held.get(s, 0) + k
    assert held == counts


def test_undominated_fillings():
    """Fillings by trying all multisets, without those in which an item left could do better."""
    r = random.Random(3)
    for _ in range(60):
        sizes = {r.randint(1, 12): r.randint(1, 3) for _ in range(r.randint(1, 6))}
        items = [s for s, n in sizes.items() for _ in range(n)]
        room, waste = r.randint(0, 20), r.randint(0, 4)
        expect = set()
        for n in range(len(items) + 1):
            for some in set(itertools.combinations(sorted(items, reverse=True), n)):
                left = room - sum(some)
                if not 0 <= left <= waste:
                    continue
                better = False
                for s in sizes:
                    if sizes[s] > some.count(s):
                        for m in range(n + 1):
                            for part in itertools.combinations(some, m):
                                better |= s <= sum(part) + left and (m > 1 and sum(part) <= s or m < 2 and sum(part) < s)
                if not better:
                    expect.add(some)
        found = [f for f in packing.fillings(sizes, room, waste) if f is not None]
        assert len(found) == len(set(found)) and set(found) == expect


def test_a_text_of_more_than_a_sequence_is_cut():
    assert packing._cut(1, 1024) == [(0, 1)]
    assert packing._cut(1024, 1024) == [(0, 1024)]
    assert packing._cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]


@pytest.mark.parametrize("texts", [ODD_TEXTS, ["a b c " * 300] * 7 + [None] * 5])
def test_op9(spark, tmp_path, texts):
    sf = write_tables(tmp_path, list(enumerate(texts)))
    rows = packing.query(spark, sf).collect()
    expect = set()
    for i, text in enumerate(texts):
        own = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expect |= {(i, k, a, n, zlib.crc32(own[a : a + n].tobytes())) for k, (a, n) in enumerate(packing._cut(len(own), 1024))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == expect
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
