"""Near-duplicate documents by min-max hashing.

Each set of word shingles is hashed by ``PERMUTATIONS`` permutations, and both
the least and the greatest value under each are kept: two nearly independent
samples for one evaluation.  ``BAND`` permutations make a band of twice as many
values; two sets of similarity s share a band with probability
1 - (1 - s ** (2 * BAND)) ** BANDS, which at 0.8 is one less 4.6e-7.

1. Equal sets are one class; the rest works on one document of each class.
2. In each bucket of a band all members are paired with the least one, and the
   distinct pairs are confirmed on the full sets.
3. Buckets whose members are then in one component are done.  In the others
   all members outside the bucket's largest component are compared with all
   others, by their full sets, a pair of blocks a task.  Each task returns a
   spanning forest of the links it found, so what comes out grows with the
   members and not with their pairs.

No bucket is capped.  Defined results: a text without words (or null) has an
empty set and is linked with nothing.  Rows are told apart by the numbers that
``placed`` gives them, so null and repeated ids are allowed; repeated rows are
copies of each other.  A component's id is the least id in it, null if all are
null.  Words and shingles are held by 64-bit hashes and equal sets are told by
128 bits: two different shingles of one pair of texts count as one with a
probability of about 3e-20 for each pair of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgate.llm import fixed_filter
from crawlgate.llm.common import lean, placed, prefixed, release, small_batches, table, written
from crawlgate.llm.components import components
from crawlgate.llm.shingles import _mixed, digest_of, min_max, sets_of

BAND = 3
BANDS = 48
PERMUTATIONS = BAND * BANDS
#: Members of a block; larger buckets are compared block by block.
BLOCK = 1024
#: Texts hashed together.
ROWS = 500
#: Bits of the filter that names the documents whose sets are needed again: 2 MB on every executor, at any size.
FILTER_BITS = 1 << 24
#: Shingles compared at once.
COLUMNS = 2048
#: Rows whose links are told at once, and bytes of sets after which a worker gives memory back.
SLAB = 128
LARGE = 2_000_000


def _signed(texts: DataFrame, width: int) -> DataFrame:
    """``node``, ``n_shingles``, ``digest`` and ``bands`` of each row."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                shingles, starts = sets_of(part.column(1).to_pylist(), width)
                full = np.flatnonzero(np.diff(starts) > 0)
                values = min_max(shingles, starts, PERMUTATIONS).reshape(len(full), BANDS, 2 * BAND).astype(np.uint64)
                keys = np.zeros((len(full), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for k in range(2 * BAND):
                    keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
                counts = np.zeros(part.num_rows, np.int32)
                counts[full] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
                digests = pa.array([digest_of(shingles[starts[i] : starts[i + 1]]) for i in range(part.num_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(starts)), digests, bands], names=["node", "n_shingles", "digest", "bands"])

    return texts.mapInArrow(lean(signed), "node long, n_shingles long, digest binary, bands array<long>")


def _sets(texts: DataFrame, width: int, nodes: DataFrame) -> DataFrame:
    """``node`` and ``shingles`` (eight bytes each, in order) of the nodes, and of few others."""
    h = F.xxhash64("node").alias("h")
    bits = texts.sparkSession.sparkContext.broadcast(fixed_filter.made(nodes.select(h), FILTER_BITS))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(fixed_filter.held(bits.value, batch.column(2).to_numpy())))
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                shingles, starts = sets_of(part.column(1).to_pylist(), width)
                sets = [shingles[starts[i] : starts[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return texts.select("node", "text", h).mapInArrow(lean(made), "node long, shingles binary")


def alike(inter: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """Whether the intersection is ``percent`` of the union or more."""
    return 100 * inter >= percent * (n + m - inter)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets are alike."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                s, t = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                possible = 100 * min(len(s), len(t)) >= percent * max(len(s), len(t))
                keep.append(possible and bool(alike(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), percent)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(lean(confirm), "a long, b long")


def _forest(group: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links that join the rows' components, found by comparing rows of different ones in full."""
    group = group.drop_duplicates("node")
    nodes = group["node"].to_numpy(np.int64)
    root = {c: c for c in group["root"]}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
    sizes = np.array([len(x) for x in sets], np.int64)
    every, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Only shingles of two rows or more can be shared.
    number = np.cumsum(counts > 1) - 1
    keep, owner = counts[codes] > 1, np.repeat(np.arange(len(sets)), sizes)
    codes, owner = number[codes][keep], owner[keep]
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int(codes[-1]) + 1 if len(codes) else 0, COLUMNS):
        i, j = np.searchsorted(codes, [begin, begin + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[owner[i:j], codes[i:j] - begin] = 1
        inter += x @ x.T
        del x
    roots, out = group["root"].to_numpy(np.int64), []
    for begin in range(0, len(sets), SLAB):
        part = slice(begin, begin + SLAB)
        found = np.triu(alike(inter[part].astype(np.int64), sizes[part, None], sizes[None, :], percent), begin + 1)
        for i, j in zip(*np.nonzero(found)):
            i += begin
            p, q = top(int(roots[i])), top(int(roots[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _rest(buckets: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components inside the buckets that hold several.

    A link has an end outside the bucket's largest component, so only what is
    outside is compared with all: the members of the largest are not compared
    with each other, however many there are.
    """
    marked = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = marked.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    largest = parts.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("major"), F.sum("m").alias("n"), F.max("m").alias("m")).filter("m < n")
    # Buckets of the same members are compared once.
    members = marked.join(largest, "key")
    names = members.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("y"), F.first("n").alias("n"))
    once = written(names.groupBy("x", "y", "n").agg(F.min("key").alias("key")).select("key").join(largest, "key"), "open")
    members = marked.join(once, "key").withColumn("minor", F.col("root") != F.col("major"))
    # Minor block i meets each minor block j in the task (i, j), and each major block j in (i, -1 - j).
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    minors, majors = blocks(F.col("n") - F.col("m")), blocks(F.col("m"))
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("minor"), minors).otherwise(majors)).cast("int"))
    task = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    among = F.transform(F.sequence(F.lit(0), minors - 1), lambda j: task(F.least("own", j), F.greatest("own", j)))
    across = F.transform(F.sequence(F.lit(0), majors - 1), lambda j: task(F.col("own"), -1 - j))
    met = F.transform(F.sequence(F.lit(0), minors - 1), lambda i: task(i, -1 - F.col("own")))
    dealt = members.select("key", "node", "root", F.inline(F.when(F.col("minor"), F.concat(among, across)).otherwise(met))).join(sets, "node")

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(_forest(group, percent), columns=["a", "b"]).astype("int64")
        if group["shingles"].str.len().sum() > LARGE:
            release()
        return found

    return dealt.groupBy("key", "i", "j").applyInPandas(compared, "a long, b long").distinct()


def classes(texts: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``node``, ``n_shingles`` and ``root`` (the least node it reaches) of each row of ``node`` and ``text``.

    Rows must have the same ``node`` when they are read again: see ``placed``.
    """
    small_batches(texts.sparkSession)
    signed = written(_signed(texts, width), "signed")
    full = signed.filter("n_shingles > 0")
    firsts = full.groupBy("digest").agg(F.min("node").alias("first"))
    nodes = full.join(firsts.select(F.col("first").alias("node")), "node", "left_semi")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "hub")
    buckets = written(keys.join(hubs, "key"), "buckets")
    sets = written(_sets(texts, width, buckets.select("node").distinct()), "sets")
    pairs = buckets.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = written(_confirmed(pairs, sets, percent), "links")
    rest = _rest(buckets.select("key", "node"), components(links), sets, percent)
    roots = components(links.unionByName(written(rest, "links")))
    known = full.select("node", "digest", "n_shingles").join(firsts, "digest")
    reached = known.join(roots.withColumnsRenamed({"node": "first"}), "first", "left").select("node", "n_shingles", F.coalesce("root", "first").alias("root"))
    return reached.unionByName(signed.filter("n_shingles = 0").select("node", "n_shingles", F.col("node").alias("root")))


def components_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row."""
    rows = placed(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "node")
    found = written(classes(rows.select("node", "text"), width, percent), "classes")
    rows = rows.select("node", "doc_id").join(found, "node")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    rows = rows.join(least, "root")
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def dedupe(docs: DataFrame, text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that another row of their component comes before; all columns stay."""
    p = prefixed(docs.columns)
    mark, may = p + "node", p + "may"
    rows = placed(docs, mark)
    texts = rows.select(F.col(mark).alias("node"), F.col(f"`{text}`").alias("text"))
    gone = written(classes(texts, width, percent).filter("node <> root").select(F.col("node").alias(mark)), "gone")
    bits = fixed_filter.made(gone.select(F.xxhash64(mark).alias("h")), FILTER_BITS)
    # Most rows stay and are not moved.
    rows = rows.withColumn(may, fixed_filter.holds(docs.sparkSession, bits)(F.xxhash64(mark)))
    stay = rows.filter(~F.col(may)).unionByName(rows.filter(F.col(may)).join(gone, mark, "left_anti"))
    return stay.drop(mark, may)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the table's near-duplicates on shingles of four words."""
    return components_of(table(spark, sf_dir, "documents"), width=4)


#: DuckDB SQL: links by counting common shingles of one document of each class, components by reaching along links.
ORACLE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM docs
), classes AS (
  SELECT min(r) AS c, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS (
  SELECT c, n, unnest(s) AS x FROM classes
), links AS (
  SELECT a.c AS x, b.c AS y FROM shingles a JOIN shingles b ON a.x = b.x AND a.c <> b.c
  GROUP BY a.c, b.c HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(c, d) AS (
  SELECT c, c FROM classes UNION SELECT reach.c, links.y FROM reach JOIN links ON links.x = reach.d
), roots AS (
  SELECT c, min(d) AS root FROM reach GROUP BY c
), members AS (
  SELECT sets.r, sets.doc_id, len(sets.s) AS n, roots.root FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN roots ON roots.c = classes.c
), least AS (
  SELECT root, min(doc_id) AS component_id FROM members WHERE root IS NOT NULL GROUP BY root
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN root IS NULL THEN doc_id ELSE component_id END AS component_id, coalesce(root IS NULL AND doc_id IS NOT NULL OR doc_id = component_id, false) AS kept
FROM members LEFT JOIN least USING (root)
"""
