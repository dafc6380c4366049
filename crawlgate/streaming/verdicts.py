"""An extension: URLs that arrive as a stream, judged by policies that stand still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgate.plans.verdicts import score


def stream_verdicts(urls: DataFrame, policies: DataFrame) -> DataFrame:
    """``score`` on a streaming table of ``url_id`` and ``url``: a stream-static join without state."""
    return score(urls, policies)


def fetch_slots(urls: DataFrame, policies: DataFrame, watermark: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """For each origin and window of ``ts``: URLs asked for, and how many its delay leaves time for.

    ``urls`` streams ``url_id``, ``url``, ``ts``; ``policies`` has ``origin``
    and ``delay``, one row for each origin.
    """
    from crawlgate.functions.urls import origin

    rows = urls.withWatermark("ts", watermark).withColumn("origin", origin(F.col("url"))).join(policies.select("origin", "delay"), "origin", "left")
    counted = rows.groupBy(F.window("ts", width).alias("slot"), "origin").agg(F.count(F.lit(1)).alias("asked"), F.max("delay").alias("delay"))
    seconds = F.unix_timestamp("slot.end") - F.unix_timestamp("slot.start")
    room = F.when(F.col("delay") > 0, F.floor(seconds / F.col("delay"))).cast("long")
    return counted.select(F.col("slot.start").alias("begin"), "origin", "asked", "delay", F.least("asked", F.coalesce(room, F.col("asked"))).alias("granted"))
