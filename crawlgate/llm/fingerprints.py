"""Document fingerprints: a digest of quartile codes of hashed byte triplets.

Triplets of bytes, picked at six spacings inside a sliding window, are hashed
into ``BUCKETS`` counters.  The digest holds the text's length on a
logarithmic scale and two bits for each counter: the quartile, among the
text's own counters, that its count falls into.  The difference of two digests
is the sum of the differences of these codes plus a bounded part for the
length; likeness is one less the difference over the largest one possible.

Defined results: a null text counts as empty; the empty text and those too
short for any triplet have zero counters, so they differ by length alone.
Equal texts have equal digests.  ``with_next`` orders rows by id, null first,
and rows of equal id by a hash of their text; the last row's next is the first,
and a single row is its own next.  Texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgate.llm.common import table

BUCKETS = 1024
#: Places of the second and third byte of a triplet after its first.
SPACINGS = ((3, 7), (4, 9), (5, 11), (5, 12), (2, 9), (6, 10))
#: The largest difference of the codes, and what the length can add at most.
MOST_CODES = 3 * BUCKETS
MOST_LENGTH = MOST_CODES // 16


def _tables() -> np.ndarray:
    """A bucket for each byte at each place of each spacing, by one hash."""
    seed = np.frombuffer(hashlib.shake_128(b"triplets").digest(2 * 3 * 256 * len(SPACINGS)), "<u2")
    return (seed % BUCKETS).reshape(len(SPACINGS), 3, 256)


_TABLES = _tables()


def counters(body: bytes) -> np.ndarray:
    """How many triplets fall into each bucket."""
    x = np.frombuffer(body, np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    for (a, b), (ta, tb, tc) in zip(SPACINGS, _TABLES):
        n = len(x) - b
        if n > 0:
            out += np.bincount((ta[x[:n]] + tb[x[a : a + n]] + tc[x[b : b + n]]) % BUCKETS, minlength=BUCKETS)
    return out


def digest(text: str | None) -> str:
    """The fingerprint of a whole text, in hexadecimal."""
    body = (text or "").encode("utf-8")
    c = counters(body)
    q = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (c > q[0]).astype(np.uint8) + (c > q[1]) + (c > q[2])
    packed = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    length = min(255, round(16 * math.log2(1 + len(body) / 16)))
    return f"{length:02x}" + packed.astype(np.uint8).tobytes().hex()


def _codes(fingerprint: str) -> np.ndarray:
    x = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    return np.stack([x >> 6, x >> 4 & 3, x >> 2 & 3, x & 3], 1).astype(np.int16)


def likeness(one: str, other: str) -> float:
    """1 for equal digests, 0 for the largest difference."""
    if one == other:
        return 1.0
    length = min(MOST_LENGTH, 2 * abs(int(one[:2], 16) - int(other[:2], 16)))
    return 1 - (int(np.abs(_codes(one) - _codes(other)).sum()) + length) / (MOST_CODES + MOST_LENGTH)


def fingerprinter():
    """A column function: text -> digest."""

    @F.pandas_udf("string")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([digest(x) for x in batch], index=batch.index, dtype=object)

    return fingerprint


def comparer():
    """A column function: two digests -> their likeness; null if either is null."""

    @F.pandas_udf("double")
    def compared(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) if x and y else None for x, y in zip(one, other)], index=one.index, dtype=float)

    return compared


#: Ranges for each shuffle partition, so that hashing ranges to partitions stays even.
RANGES = 4
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ranged(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` of ``doc_id``, ``h``, ``text`` with ``range``, which rises with (doc_id, h).

    About ``n`` ranges hold as many rows each; an id that would fill several is
    split by ``h`` into as many, and so are null ids into ``n``: there are
    ``2 * n`` ranges at most.
    """
    found = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n).alias("q")).first()["q"] or []
    splits, often = np.unique(np.array(found, np.int64), return_counts=True)
    parts = np.concatenate([[1], often])
    sent = rows.sparkSession.sparkContext.broadcast((splits, parts, np.cumsum(parts) - parts))  # n - 1 numbers at most

    @F.pandas_udf("long")
    def number(ids: pd.Series, null: pd.Series, h: pd.Series) -> pd.Series:
        splits, parts, first = sent.value
        i, share = ids.to_numpy(np.int64), (h.to_numpy(np.int64).astype(float) + 2.0**63) / 2.0**64
        k = np.searchsorted(splits, i, "right")
        # Ids above the one that a range begins with come in its last part.
        begins = (k > 0) & (splits[np.maximum(k - 1, 0)] == i) if len(splits) else np.zeros(len(i), bool)
        part = np.where(begins, np.minimum(share * parts[k], parts[k] - 1), parts[k] - 1).astype(np.int64)
        none = np.minimum((share * n).astype(np.int64), n - 1) - n
        return pd.Series(np.where(null.to_numpy(bool), none, first[k] + part), index=ids.index)

    return rows.withColumn("range", number(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("h")))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each row's next is the row after it in its range, or the range's closing row."""
    at, before = None, None
    for batch in batches:
        out = []
        for r, closing, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if r != at:
                at, before = r, None
            mark = digest(text)
            if before is not None:
                before_id, body, own = before
                n = len(body)
                cut = n // 4
                edited = body[: n - cut] + text[:cut]
                changed = digest(edited)
                out.append((before_id, n, hashlib.sha256(edited.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, mark)))
            # Equal closing rows may follow; the first one ends the range.
            before = None if closing else (doc_id, text, mark)
        columns = list(zip(*out)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in _OUT.split(", ")])


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's digests, its text edited with the next one's beginning, and their likeness.

    Documents are dealt out by ranges of the id and sorted inside; the first
    of each range is also sent to the range before, to close it.  No other
    text is moved twice.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.select(F.col(f"`{doc_id}`")).dtypes[0][1]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids are whole numbers, in whose order documents follow each other, and not {kind}")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = _ranged(rows.withColumn("h", F.xxhash64("text")), RANGES * n)
    # One row for each range, so twice RANGES for each partition at most.
    firsts = rows.groupBy("range").agg(F.min(F.struct("doc_id", "h")).alias("x")).select("range", "x.*").collect()
    firsts = sorted(map(tuple, firsts), key=lambda r: r[0])
    if not firsts:
        return spark.createDataFrame([], _OUT)
    closes = spark.createDataFrame([(firsts[k - 1][0], *x) for k, x in enumerate(firsts)], "closed long, range long, doc_id long, h long")
    same = (rows["range"] == closes["range"]) & rows["doc_id"].eqNullSafe(closes["doc_id"]) & (rows["h"] == closes["h"])
    closing = rows.join(F.broadcast(closes), same).select(F.col("closed").alias("range"), F.lit(1).alias("closing"), rows["doc_id"], rows["h"], "text").dropDuplicates(["range"])
    dealt = rows.select("range", F.lit(0).alias("closing"), "doc_id", "h", "text").unionByName(closing)
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "closing", "doc_id", "h")
    return dealt.select("range", "closing", "doc_id", "text").mapInArrow(_walked, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document and its next."""
    return with_next(table(spark, sf_dir, "documents"))
