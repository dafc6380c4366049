"""Verdicts: may an agent fetch a URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgate.functions.urls import located_target, prepare_url
from crawlgate.operators.patterns import RULE_TYPE, decision


def prepared(urls: DataFrame) -> DataFrame:
    """``urls`` with ``origin`` and ``target``, the text that rules are matched with."""
    return urls.select("*", F.inline(F.array(located_target(F.col("url")))))


def score(urls: DataFrame, policies: DataFrame) -> DataFrame:
    """``url_id``, ``agent``, ``allowed``, ``rule``, ``reason`` for each URL and policy of its origin.

    ``policies`` has the columns of ``compile_policies`` and ``origin``; a URL
    whose origin has no policy gets one row with a null agent, allowed.  The
    join is by origin; Spark broadcasts the policies if they are small, and
    splits hosts with very many URLs if they are not.
    """
    rows = prepared(urls).join(policies.select("origin", "agent", "rules", "error"), "origin", "left")
    return _judged(rows)


def check(urls: DataFrame, policies: DataFrame) -> DataFrame:
    """Like ``score`` for URLs that name their file by ``robots_id``, absolute or relative."""
    rows = urls.withColumn("target", prepare_url(F.col("url"))).join(policies.select("robots_id", "agent", "rules", "error"), "robots_id")
    return _judged(rows)


def _judged(rows: DataFrame) -> DataFrame:
    rules = F.coalesce("rules", F.array().cast(f"array<{RULE_TYPE}>"))
    # inline() holds the decision, which is read three times below.
    rows = rows.select("url_id", "agent", "target", "error", F.col("rules").isNull().alias("no_file"), F.inline(F.array(F.struct(decision(rules, F.col("target")).alias("by")))))
    exempt = F.col("target") == "/robots.txt"
    return rows.select(
        "url_id",
        "agent",
        F.when(exempt, True).otherwise(F.coalesce("by.is_allowed", F.lit(True))).alias("allowed"),
        F.when(~exempt, F.col("by.pattern")).alias("rule"),
        F.when(exempt, "robots_txt").when(F.col("no_file"), "no_robots").when(F.col("error").isNotNull(), "bad_robots").when(F.col("by").isNull(), "no_rule").otherwise("rule").alias("reason"),
    )


def http_policy(status):
    """An extension: what a robots file's HTTP status asks for."""
    return F.when(status.between(200, 299), "parse").when(status.between(300, 399), "follow").when(status == 429, "retry").when(status.between(400, 499), "allow_all").when(status.between(500, 599), "disallow_all").otherwise("unknown")
