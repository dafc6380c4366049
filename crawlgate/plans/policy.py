"""Policies: what each robots file says to each agent.

A file is one row from its bytes to its policies: it is read, grouped and
compiled by array functions, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgate.functions.latin1 import let, to_text
from crawlgate.operators.groups import agent_key, file_key, sections
from crawlgate.operators.lexer import entries
from crawlgate.operators.patterns import MAX_ANCHORED, RULE_TYPE, compiled, too_long


def parsed(content: Column, max_bytes: int | None = None) -> Column:
    """A file as a struct of ``sections`` (their ``agents``, ``rules`` and ``delays``) and ``sitemaps``.

    Rules are compiled here, once a file, whatever the number of agents.
    """

    def section(e: Column) -> Column:
        rules = F.transform(F.filter(e, lambda x: x["kind"].isin("allow", "disallow")), lambda x: compiled(x["line_no"], x["value"], x["kind"] == "allow"))
        return F.struct(
            F.transform(F.filter(e, lambda x: x["kind"] == "user_agent"), lambda x: file_key(x["value"])).alias("agents"),
            F.filter(rules, lambda r: r.isNotNull()).alias("rules"),
            F.transform(F.filter(e, lambda x: x["kind"] == "crawl_delay"), lambda x: x["delay"]).alias("delays"),
        )

    def file(known: Column) -> Column:
        sitemaps = F.transform(F.filter(known, lambda e: e["kind"] == "sitemap"), lambda e: to_text(e["value"]))
        return F.struct(F.transform(sections(known), section).alias("sections"), F.filter(sitemaps, lambda x: x.isNotNull()).alias("sitemaps"))

    return let(entries(content, max_bytes), file)


def parsed_files(robots: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One row for each file: ``robots_id``, ``sections`` and ``sitemaps``."""
    return robots.select("robots_id", F.inline(F.array(parsed(F.col("content"), max_bytes))))


def compile_policies(robots: DataFrame, agents: DataFrame, max_anchored: int = MAX_ANCHORED, max_bytes: int | None = None) -> DataFrame:
    """A policy for each file and agent.

    ``robots`` has ``robots_id`` and binary ``content``; ``agents`` has
    ``agent``, and ``robots_id`` too where each file has its own agents.
    Without it every file is asked for all agents, whose list goes along with
    the files as one array.  Agents that a file does not tell apart share the
    rules, which are chosen once for all of them.
    """
    asked = F.sort_array(F.collect_set(F.struct("agent", agent_key(F.col("agent")).alias("key"))))
    files = parsed_files(robots, max_bytes)
    if "robots_id" in agents.columns:
        rows = files.join(agents.groupBy("robots_id").agg(asked.alias("asked")), "robots_id")
    else:
        rows = files.join(agents.agg(asked.alias("asked")), F.lit(True))
    # The agent itself where the file names it in full, else "*".
    named = F.array_distinct(F.flatten(F.transform("sections", lambda s: s["agents"])))
    matched = let(named, lambda n: F.transform("asked", lambda a: F.struct(a["agent"].alias("agent"), F.when(F.array_contains(n, a["key"]), a["key"]).otherwise("*").alias("matched"))))
    rows = rows.select("robots_id", "sections", "sitemaps", (F.size(named) == 0).alias("unnamed"), matched.alias("asked"))
    rows = rows.select("*", F.explode(F.array_distinct(F.transform("asked", lambda a: a["matched"]))).alias("matched"))
    rows = rows.withColumn("asked", F.transform(F.filter("asked", lambda a: a["matched"] == F.col("matched")), lambda a: a["agent"]))

    def policy(own: Column) -> Column:
        rules = F.flatten(F.transform(own, lambda s: s["rules"]))
        delays = F.flatten(F.transform(own, lambda s: s["delays"]))
        return F.struct(rules.alias("rules"), F.get(delays, 0).alias("delay"), F.get(F.filter(rules, lambda r: too_long(r, max_anchored)), 0)["pattern"].alias("refused"))

    own = F.filter("sections", lambda s: F.col("unnamed") | F.array_contains(s["agents"], F.col("matched")))
    # Delays before any agent hold where the agent has none; the last one counts.
    header = let(F.get("sections", 0)["delays"], lambda d: F.get(d, F.size(d) - 1))
    rows = rows.select("robots_id", "asked", "matched", "sitemaps", header.alias("header"), F.inline(F.array(let(own, policy))))
    good = F.col("refused").isNull()
    rows = rows.select(
        "robots_id",
        "asked",
        F.coalesce(to_text(F.col("matched")), F.col("matched")).alias("matched_agent"),
        F.when(good, F.col("rules")).otherwise(F.array().cast(f"array<{RULE_TYPE}>")).alias("rules"),
        F.when(good, F.coalesce("delay", "header")).alias("delay"),
        F.when(good, F.col("sitemaps")).otherwise(F.array().cast("array<string>")).alias("sitemaps"),
        F.when(~good, F.concat(F.lit("Invalid robots.txt rule: "), "refused")).alias("error"),
    )
    return rows.select("robots_id", F.explode("asked").alias("agent"), "matched_agent", "rules", "delay", "sitemaps", "error")


def debug_policies(policies: DataFrame) -> DataFrame:
    """Policies as JSON, for people: rules as they are matched."""
    rules = F.transform("rules", lambda r: F.struct(r["pattern"].alias("pattern"), r["is_allowed"].alias("is_allowed")))
    return policies.select("robots_id", "agent", F.to_json(F.struct(rules.alias("rules"), "delay", "sitemaps")).alias("debug"))
