"""Removal of long byte strings that occur more than once, by sorted suffixes.

A string of ``length`` bytes (a window) is dealt out by content.  Its anchor is
the gram of ``GRAM`` bytes with the least hash in it; equal windows have equal
anchors at equal places.  An anchor's windows that reach ``side`` bytes to its
left have the gram and these bytes as their key, the others the gram and the
bytes to its right.

1. Keys are counted, and those that occur twice are marked in a filter of
   fixed size.
2. For marked keys only, the stretch of text that a key's windows cover (its
   context) is sent to the key's task; equal contexts of a batch are sent once,
   with their number.
3. A task sorts the suffixes of its contexts by ``deep_shallow``, key by key;
   windows of a class of two or more, and all of a context that occurs twice,
   are repeats.
   A key of over ``BLOCK`` contexts is dealt out further: windows at nearly the
   same distance from the anchor have more bytes in common, and the gram with
   these is a longer key.  ``WIDTHS`` are the distances taken together, down to
   one, where a window is its own key and its copies are one context.
4. Repeats go back to the places of their contexts, and documents that have
   any are read again and cut.

Windows are judged on the input, not on what is left.  Defined results: a null
text counts as empty; texts shorter than ``length`` bytes have no window and
stay.  A row that repeats another loses all that is as long as a window.  Rows
are told apart by the numbers that ``placed`` gives them, so null and repeated
ids are allowed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgate.llm import fixed_filter
from crawlgate.llm.common import lean, placed, prefixed, small_batches, table, written
from crawlgate.llm.shingles import _mixed
from crawlgate.llm.suffix_sort import deep_shallow

LENGTH = 200
GRAM = 64
#: Bits of the filters: 8 MB on every executor, at any size.
FILTER_BITS = 1 << 26
#: Bytes of texts handled together; windows sorted together, and bytes of their contexts.
BLOCK_BYTES = 1_500_000
SORTED = 400_000
SORTED_BYTES = 4_000_000
#: Contexts of one key that are sorted together, and how many distances from the anchor a longer key is for.
BLOCK = 4096
WIDTHS = (16, 1)
#: Contexts that are dealt out further together.
PARTED = 1024
#: Large keys that may be broadcast; beyond it they are joined by a shuffle.
MOST_SPLIT = 100_000

_C = np.uint64(0x9E3779B97F4A7C15)
#: A number for each byte, and an odd factor for each doubling of a gram.
_BYTES = np.frombuffer(hashlib.shake_128(b"bytes").digest(8 * 256), "<u8")
_FACTORS = np.frombuffer(hashlib.shake_128(b"factors").digest(8 * 16), "<u8") | np.uint64(1)
#: Bytes whose anchors are found together, so that the arrays stay in the processor's cache.
_CACHED = 128_000


def anchored(buffer: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First window, last window, anchor of each run of windows with one anchor, and the gram hashes.

    ``ends`` are the ends of the texts in ``buffer``; no window crosses one.
    """
    h = _BYTES[buffer]
    width, k = 1, 0
    while width < GRAM:
        h, width, k = h[:-width] * _FACTORS[k] + h[width:], 2 * width, k + 1
    h = _mixed(h)
    span = length - GRAM + 1
    # The hash's upper part and the place: the least is the leftmost of equal ones.
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    anchor = least.astype(np.uint32).astype(np.int64)
    sizes = np.diff(ends, prepend=0)
    inside = np.arange(len(anchor)) + length <= np.repeat(ends, sizes)[: len(anchor)]
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    begin = np.flatnonzero(change)
    stop = np.append(begin[1:], len(anchor)) - 1
    # Windows of one anchor across two texts cannot both be inside.
    keep = inside[begin]
    return begin[keep], stop[keep], anchor[begin][keep], h


def _some_parts(buffer: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    begin, stop, anchor, h = anchored(buffer, ends, length)
    side = (length - GRAM) // 2

    def hashed(at: np.ndarray, seed: int) -> np.ndarray:
        """A hash of GRAM + side bytes: two grams that overlap or meet."""
        return _mixed(_mixed(h[at] * _C + h[at + side]) + np.uint64(seed))

    # Windows that begin ``side`` bytes or more before the anchor, then the rest.
    left_stop = np.minimum(stop, anchor - side)
    has = left_stop >= begin
    left = begin[has], left_stop[has] - begin[has] + 1, hashed(anchor[has] - side, 1), anchor[has]
    right_begin = np.maximum(begin, anchor - side + 1)
    has = right_begin <= stop
    right = right_begin[has], stop[has] - right_begin[has] + 1, hashed(anchor[has], 2), anchor[has]
    return tuple(np.concatenate(x) for x in zip(left, right))


def parts(buffer: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, key and anchor of each anchor's left and right part."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    at = text = 0
    while text < len(ends):
        after = max(text + 1, int(np.searchsorted(ends, at + _CACHED, "right")))
        stop = int(ends[after - 1])
        if stop - at >= length:
            begin, windows, keys, anchors = _some_parts(buffer[at:stop], ends[text:after] - at, length)
            found.append((begin + at, windows, keys, anchors + at))
        at, text = stop, after
    return tuple(np.concatenate(x) for x in zip(*found))


#: Rows of a batch that are taken out of Arrow together.
ROWS = 256


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Row numbers and texts, a million bytes or two at a time."""
    for batch in batches:
        nodes, at, size, bodies = batch.column(0).to_numpy(), 0, 0, []
        for begin in range(0, batch.num_rows, ROWS):
            for i, text in enumerate(batch.column(1).slice(begin, ROWS).to_pylist(), begin):
                body = text.encode("utf-8") if text else b""
                if bodies and size + len(body) > BLOCK_BYTES:
                    yield nodes[at:i], bodies
                    at, size, bodies = i, 0, []
                bodies.append(body)
                size += len(body)
        if bodies:
            yield nodes[at:], bodies


def _joined(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([len(b) for b in bodies])


def _keys(texts: DataFrame, length: int) -> DataFrame:
    """``key`` and how often a block of texts has it."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, bodies in _blocks(batches):
            keys, counts = np.unique(parts(*_joined(bodies), length)[2].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.minimum(counts, 2).astype(np.int8))], names=["key", "n"])

    return texts.mapInArrow(lean(made), "key long, n byte")


_CONTEXTS = "key long, context_id binary, n int, context binary, anchor int, node long, start int"


def _contexts(texts: DataFrame, length: int, bits: np.ndarray) -> DataFrame:
    """For marked keys: a row for each place (``node``, ``start``), and one for each distinct context of a block."""
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, bodies in _blocks(batches):
            buffer, ends = _joined(bodies)
            begin, windows, keys, anchors = parts(buffer, ends, length)
            keys = keys.view(np.int64)
            keep = fixed_filter.held(sent.value, keys)
            begin, windows, keys, anchors = begin[keep], windows[keep], keys[keep], anchors[keep]
            owner = np.searchsorted(ends, begin, "right")
            starts = begin - np.concatenate([[0], ends])[owner]
            whole, seen, ids = buffer.tobytes(), {}, []
            for b, n, key, anchor in zip(begin.tolist(), windows.tolist(), keys.tolist(), anchors.tolist()):
                context = whole[b : b + n + length - 1]
                mark = xxhash.xxh3_128_digest(context, key & 0xFFFFFFFF)
                ids.append(mark)
                if mark in seen:
                    seen[mark][1] += 1
                else:
                    seen[mark] = [key, 1, context, anchor - b]
            none = len(seen)
            table = pa.table(
                {
                    "key": pa.array([x[0] for x in seen.values()] + [None] * len(ids), pa.int64()),
                    "context_id": pa.array([*seen, *ids], pa.binary()),
                    "n": pa.array([x[1] for x in seen.values()] + [None] * len(ids), pa.int32()),
                    "context": pa.array([x[2] for x in seen.values()] + [None] * len(ids), pa.binary()),
                    "anchor": pa.array([x[3] for x in seen.values()] + [None] * len(ids), pa.int32()),
                    "node": pa.array([None] * none + nodes[owner].tolist(), pa.int64()),
                    "start": pa.array([None] * none + starts.tolist(), pa.int32()),
                }
            )
            yield from table.combine_chunks().to_batches()

    return texts.mapInArrow(lean(made), _CONTEXTS)


_PARTS = "key long, context_id binary, n int, context binary, anchor int, whole binary, shift int"


def _parted(contexts: DataFrame, width: int, length: int) -> DataFrame:
    """Contexts of longer keys: those of ``width`` distances from the anchor each, and a row for each that says where it is in which whole one."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, PARTED) for b in batches for i in range(0, b.num_rows, PARTED)):
            seen: dict[bytes, list] = {}
            where: list[tuple[bytes, bytes, int]] = []
            for whole, n, context, anchor in zip(*(c.to_pylist() for c in batch.columns)):
                first = 0
                last = len(context) - length
                while first <= last:
                    # The window at ``first`` is ``anchor - first`` bytes before the anchor.
                    low = (anchor - first) // width * width
                    stop = min(last, anchor - low)
                    # What all windows of these distances have in common.
                    core = context[anchor - low : anchor - low - width + 1 + length]
                    key = xxhash.xxh3_64_intdigest(core, low << 8 | width)
                    part = context[first : stop + length]
                    mark = xxhash.xxh3_128_digest(part, key & 0xFFFFFFFF)
                    where.append((mark, whole, first))
                    if mark in seen:
                        seen[mark][1] += n
                    else:
                        seen[mark] = [key - (key >> 63 << 64), n, part, anchor - first]
                    first = stop + 1
            none, at = [None] * len(seen), [None] * len(where)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in seen.values()] + at, pa.int64()),
                    pa.array([*seen, *(w[0] for w in where)], pa.binary()),
                    pa.array([x[1] for x in seen.values()] + at, pa.int32()),
                    pa.array([x[2] for x in seen.values()] + at, pa.binary()),
                    pa.array([x[3] for x in seen.values()] + at, pa.int32()),
                    pa.array([*none, *(w[1] for w in where)], pa.binary()),
                    pa.array([*none, *(w[2] for w in where)], pa.int32()),
                ],
                names=["key", "context_id", "n", "context", "anchor", "whole", "shift"],
            )

    return contexts.select("context_id", "n", "context", "anchor").mapInArrow(lean(made), _PARTS)


def repeats(groups: list[list[tuple[bytes, int, bytes]]], length: int) -> dict[str, list]:
    """Runs of repeated windows in groups of contexts.

    A context is (id, how often it occurs, bytes); only contexts of one group
    are compared.
    """
    contexts = [c for g in groups for c in g]
    buffer, ends = _joined([c[2] for c in contexts])
    begins = np.concatenate([[0], ends[:-1]])
    sizes = ends - begins - length + 1
    owner = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = begins[owner] + offset
    ends_of = np.cumsum([len(g) for g in groups])
    order, group = deep_shallow(buffer, places, length, np.add.reduceat(sizes, np.concatenate([[0], ends_of[:-1]])))
    count = np.bincount(group, minlength=len(order))[group]
    twice = np.zeros(len(places), bool)
    twice[order] = count > 1
    twice |= np.array([c[1] > 1 for c in contexts])[owner]
    flat = np.concatenate([[False], twice, [False]])
    # Runs of repeated windows, cut where a context ends.
    edge = np.zeros(len(places) + 1, bool)
    edge[np.cumsum(sizes) - sizes] = True
    opens = np.flatnonzero(twice & (~flat[:-2] | edge[:-1]))
    closes = np.flatnonzero(twice & (~flat[2:] | np.append(edge[1:-1], True)))
    return {"context_id": [contexts[k][0] for k in owner[opens]], "a": offset[opens].tolist(), "b": (offset[closes] + 1).tolist()}


_REPEATS = "context_id binary, a int, b int"


def _sorted(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of ``key``; the contexts of a key are sorted together."""
        waiting: list[list[tuple[bytes, int, bytes]]] = []
        group: dict[bytes, list] = {}
        at, windows, size = None, 0, 0

        def done() -> pa.RecordBatch:
            found = repeats(waiting, length)
            return pa.RecordBatch.from_arrays([pa.array(found[k], t) for k, t in (("context_id", pa.binary()), ("a", pa.int32()), ("b", pa.int32()))], names=["context_id", "a", "b"])

        def close() -> tuple[int, int]:
            """Moves the group over, unless it is one context that occurs once; its windows and bytes."""
            own = [(k, n, c) for k, (n, c) in group.items()]
            group.clear()
            if len(own) > 1 or own and own[0][1] > 1:
                waiting.append(own)
                bytes_ = sum(len(c[2]) for c in own)
                return bytes_ - len(own) * (length - 1), bytes_
            return 0, 0

        for batch in batches:
            for key, context_id, n, context in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    more, bytes_ = close()
                    windows, size, at = windows + more, size + bytes_, key
                    if windows >= SORTED or size >= SORTED_BYTES:
                        yield done()
                        waiting, windows, size = [], 0, 0
                if context_id in group:
                    group[context_id][0] += n
                else:
                    group[context_id] = [n, context]
        close()
        if waiting:
            yield done()

    return run


def _sizes(contexts: DataFrame) -> tuple[DataFrame, bool, bool]:
    """Keys of over ``BLOCK`` contexts, whether there are any, and whether they may be broadcast."""
    large = written(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > BLOCK).select("key"), "large")
    n = large.count()
    return large, n > 0, n <= MOST_SPLIT


def spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``node`` and ``spans``, byte ranges that repeated windows cover, unordered and overlapping, of rows of ``node`` and ``text``.

    Rows must have the same ``node`` when they are read again: see ``placed``.
    """
    spark = texts.sparkSession
    small_batches(spark)
    if length % 8 or length < 2 * GRAM:
        raise ValueError(f"length must be a multiple of 8, of {2 * GRAM} or more")
    twice = _keys(texts, length).groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    made = written(_contexts(texts, length, fixed_filter.made(twice.select("key"), FILTER_BITS)), "contexts")
    places = made.filter("node IS NOT NULL").select("context_id", "node", "start")
    contexts = made.filter("context IS NOT NULL").select("key", "context_id", "n", "context", "anchor")
    dealt, wholes = [], []
    often = F.least(F.sum("n"), F.lit(2)).cast("int").alias("n")  # more than once is all that counts
    for width in WIDTHS:
        large, any_, few = _sizes(contexts)
        if not any_:
            break
        large = F.broadcast(large) if few else large
        dealt.append(contexts.join(large, "key", "left_anti"))
        # Equal contexts of all texts become one before they are parted.
        merged = contexts.join(large, "key", "left_semi").groupBy("context_id").agg(often, F.first("context").alias("context"), F.first("anchor").alias("anchor"))
        parted = written(_parted(merged, width, length), "parted")
        wholes.append(parted.filter("whole IS NOT NULL").select("context_id", "whole", "shift"))
        contexts = parted.filter("context IS NOT NULL").select("key", "context_id", "n", "context", "anchor")
        contexts = contexts.groupBy("context_id").agg(F.first("key").alias("key"), often, F.first("context").alias("context"), F.first("anchor").alias("anchor"))
        contexts = written(contexts.select("key", "context_id", "n", "context", "anchor"), "merged")
    dealt.append(contexts)
    rows = dealt[0].select("key", "context_id", "n", "context")
    for more in dealt[1:]:
        rows = rows.unionByName(more.select("key", "context_id", "n", "context"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    hits = written(rows.mapInArrow(lean(_sorted(length)), _REPEATS), "repeats")
    for whole in reversed(wholes):
        back = hits.join(whole, "context_id").select(F.col("whole").alias("context_id"), (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b"))
        hits = hits.unionByName(back)
    cover = places.join(hits, "context_id").select("node", F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + (length - 1)).alias("b")).alias("span"))
    return cover.groupBy("node").agg(F.collect_list("span").alias("spans"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, joined where they meet."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for begin in range(0, whole.num_rows, ROWS):
            batch = whole.slice(begin, ROWS)
            kept, removed, count = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                body, at, out = (text or "").encode("utf-8"), 0, []
                ranges = merged([(r["a"], r["b"]) for r in ranges or ()])
                for a, b in ranges:
                    out.append(body[at:a])
                    at = b
                out.append(body[at:])
                kept.append(b"".join(out))
                removed.append(sum(b - a for a, b in ranges))
                count.append(len(ranges))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(count, pa.int64())], names=["node", "kept", "n_removed", "n_spans"])


def _readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left as text, without the bytes of characters that were cut."""
    for whole in batches:
        for begin in range(0, whole.num_rows, ROWS):
            batch = whole.slice(begin, ROWS)
            texts = [x.decode("utf-8", "ignore") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["node", "kept"])


def _touched(texts: DataFrame, length: int) -> tuple[DataFrame, np.ndarray]:
    """What ``cut`` returns, and a filter of the hashes of its nodes."""
    found = written(spans(texts, length), "spans")
    bits = fixed_filter.made(found.select(F.xxhash64("node").alias("h")), FILTER_BITS)
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(fixed_filter.held(sent.value, batch.column(2).to_numpy())))

    read = texts.select("node", "text", F.xxhash64("node").alias("h")).mapInArrow(lean(touched), "node long, text string")
    return read.join(found, "node").select("node", "text", "spans").mapInArrow(lean(_cut), "node long, kept binary, n_removed long, n_spans long"), bits


def cut(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``node``, ``kept`` (bytes left), ``n_removed`` and ``n_spans`` of the rows of ``node`` and ``text`` that lose any."""
    return _touched(texts, length)[0]


def dedupe(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with what ``cut`` leaves of the texts, and ``n_chars``, if there is such a column, of these.

    Removed runs can begin or end inside a character; its bytes that are left
    are dropped from the text.  No row goes, and rows that lose nothing are as
    they were.
    """
    p = prefixed(docs.columns)
    mark, kept, may = p + "node", p + "kept", p + "may"
    rows = placed(docs, mark)
    changed, bits = _touched(rows.select(F.col(mark).alias("node"), F.col(f"`{text}`").alias("text")), length)
    left = changed.select("node", "kept").mapInArrow(lean(_readable), "node long, kept string").select(F.col("node").alias(mark), F.col("kept").alias(kept))
    # Rows that lose nothing are not moved.
    rows = rows.withColumn(may, fixed_filter.holds(docs.sparkSession, bits)(F.xxhash64(mark)))
    same, rows = rows.filter(~F.col(may)), rows.filter(F.col(may)).join(left, mark, "left")

    body = F.coalesce(F.col(kept), F.col(f"`{text}`"))
    rows = rows.withColumn(text, body)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(kept).isNotNull(), F.length(text).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return same.select(*columns).unionByName(rows.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document of the table without its repeated strings of 200 bytes."""
    docs = placed(table(spark, sf_dir, "documents").select("doc_id", "text"), "node")
    body = F.coalesce("text", F.lit("")).cast("binary")
    whole = docs.select("node", "doc_id", F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha"))
    lost = cut(docs.select("node", "text")).select("node", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    rows = whole.join(lost, "node", "left")
    return rows.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


#: DuckDB SQL: windows by their place, those that occur twice by digest, and the runs that they cover.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS body FROM documents
), windows AS (
  SELECT r, i, md5(body[i + 1:i + 200]) AS h FROM (SELECT r, body, unnest(range(octet_length(body) - 199)) AS i FROM docs WHERE octet_length(body) >= 200)
), repeated AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), starts AS (
  SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true) AS opens FROM windows SEMI JOIN repeated USING (h)
), numbered AS (
  SELECT r, i, sum(CAST(opens AS INT)) OVER (PARTITION BY r ORDER BY i) AS k FROM starts
), runs AS (
  SELECT r, k, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY r, k
), gaps AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM runs
), cut AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS z, string_agg(hex(body[z + 1:a]), '' ORDER BY a) AS kept FROM gaps JOIN docs USING (r) GROUP BY r
)
SELECT doc_id, CAST(octet_length(body) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN z IS NULL THEN sha256(body) ELSE sha256(unhex(kept || hex(body[z + 1:octet_length(body)]))) END AS kept_sha256
FROM docs LEFT JOIN cut USING (r)
"""
