"""Agent groups: which directives an agent's policy takes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgate.functions.latin1 import from_text, let, lower_ascii
from crawlgate.operators.lexer import entries


def sections(known: Column) -> Column:
    """Entries (see ``entries``) without sitemaps, cut before each run of User-agent lines.

    The first section is what comes before any such line and may be empty.
    """

    def cut(k: Column) -> Column:
        is_ua = lambda e: F.coalesce(e["kind"] == "user_agent", F.lit(False))
        marked = F.transform(k, lambda e, i: F.when(is_ua(e) & ~is_ua(F.get(k, i - 1)), i))
        starts = F.concat(F.array(F.lit(0)), F.filter(marked, lambda i: i.isNotNull()), F.array(F.size(k)))
        return let(starts, lambda s: F.transform(F.slice(s, 1, F.size(s) - 1), lambda begin, j: F.slice(k, begin + 1, F.get(s, j + 1) - begin)))

    return let(F.filter(known, lambda e: e["kind"] != "sitemap"), cut)


def grouped(robots: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``robots_id``, ``line_no``, ``kind``, ``value``, ``delay``, ``grp`` (the run of User-agent lines that a line follows) and ``n_ua``.

    Sitemaps and unknown lines are left out.  Files stay in their rows until
    the lines are given out: no shuffle.
    """
    cut = robots.select("robots_id", sections(entries(F.col("content"), max_bytes)).alias("sections"))
    n_ua = F.size(F.filter(F.flatten("sections"), lambda e: e["kind"] == "user_agent")).cast("long")
    rows = cut.select("robots_id", n_ua.alias("n_ua"), F.posexplode("sections").alias("grp", "section"))
    rows = rows.select("robots_id", "n_ua", "grp", F.inline("section"))
    return rows.select("robots_id", "line_no", "kind", "value", "delay", "grp", "n_ua")


def agent_key(agent: Column) -> Column:
    """An agent as it is compared: lower case, bytes as Latin-1."""
    return from_text(F.lower(agent))


def file_key(value: Column) -> Column:
    """An agent named in a file as it is compared: A to Z in lower case."""
    return lower_ascii(value)
