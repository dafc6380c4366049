from __future__ import annotations

import re
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from crawlgate.llm import near_dedup, substring_dedup
from crawlgate.llm.common import placed
from tests.llm.conftest import write_tables


def own_mb():
    return int(re.search(r"\nRssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_workers_give_memory_back(spark):
    """What a worker frees inside its heap, below something that is still held, goes back to the system after a task."""
    from crawlgate.llm.common import lean

    held = []

    def made(batches):
        for batch in batches:
            blocks = [bytearray(b"x") * 60_000 for _ in range(3000)]
            held.append(bytearray(b"x") * 60_000)
            del blocks
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])
    list(lean(made)(iter([batch])))
    before = own_mb()
    for _ in range(3):
        assert list(lean(made)(iter([batch]))) == [batch]
    assert own_mb() < before + 40


def test_rows_are_numbered_without_python(spark, tmp_path):
    """The names of files come from the driver as they are; no Python worker reads them."""
    sf = write_tables(tmp_path, [(i, "a text", "en", "s") for i in range(9)])
    plan = placed(spark.read.parquet(f"{sf}/documents.parquet"), "n")._jdf.queryExecution().analyzed().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan


def test_large_blocks_are_compared_in_little_memory():
    """Two blocks of near copies: no array of all pairs but the one of counts, and the links by comparing pair by pair."""
    r = np.random.default_rng(5)
    base, n = np.unique(r.integers(0, 2**63, 300).astype(np.uint64)), 2 * near_dedup.BLOCK
    sets = [np.sort(np.concatenate([base[r.random(len(base)) < 0.93], r.integers(0, 2**63, 9).astype(np.uint64)])) for _ in range(n)]
    group = pd.DataFrame({"node": np.arange(n), "root": np.arange(n), "shingles": [s.tobytes() for s in sets]})
    tracemalloc.start()
    links = near_dedup._forest(group, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120_000_000
    for a, b in links:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
    top = list(range(n))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        assert root(a) != root(b)  # a forest
        top[root(a)] = root(b)
    few = range(0, n, 40)
    for i in few:
        for j in few:
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert root(i) == root(j)


@pytest.mark.parametrize("width", substring_dedup.WIDTHS)
def test_large_keys_are_parted_in_slices(monkeypatch, width):
    """Contexts of longer keys are made for some rows at a time, with all their windows."""
    monkeypatch.setattr(substring_dedup, "PARTED", 4, raising=False)
    texts = [bytes(np.random.default_rng(i).integers(0, 255, 230).astype(np.uint8)) for i in range(10)]

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, function, schema):
            batch = pa.RecordBatch.from_arrays([pa.array([bytes([i]) for i in range(10)], pa.binary()), pa.array([1] * 10, pa.int32()), pa.array(texts, pa.binary()), pa.array([60] * 10, pa.int32())], names=["context_id", "n", "context", "anchor"])
            return list(function(iter([batch])))

    out = substring_dedup._parted(Frame(), width, 200)
    assert len(out) == 3
    parts = {r["context_id"]: r["context"] for b in out for r in b.to_pylist() if r["context"] is not None}
    windows = sorted((r["whole"][0], r["shift"] + k) for b in out for r in b.to_pylist() if r["whole"] is not None for k in range(len(parts[r["context_id"]]) - 199))
    assert windows == [(i, k) for i in range(10) for k in range(31)]
    assert all(texts[r["whole"][0]][r["shift"] :].startswith(parts[r["context_id"]]) for b in out for r in b.to_pylist() if r["whole"] is not None)
