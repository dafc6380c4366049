"""Connected components of a table of links, by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgate.llm.common import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` for every node of a link; ``root`` is the least node it reaches.

    Each round hangs the larger neighbours of a node on its least neighbour,
    then the smaller ones, until nothing changes.  Neighbours are never
    gathered: a round is a minimum for each node, made before the shuffle, and
    a join.  The rounds' tables are in the shared folder, each until the next is
    there.
    """
    pair = lambda x, y: [F.greatest(x, y).alias("u"), F.least(x, y).alias("v")]
    edges = written(links.select(*pair(F.col(a), F.col(b))).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        after = written(moved.distinct(), "edges")
        mark = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        done = mark(after) == mark(edges)
        discard(edges)
        if done:
            break
        edges = after
    rooted = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
