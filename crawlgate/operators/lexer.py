"""Robots files to lines and directives, forgiving as crawlers are.

``lexed`` reads one line; ``directives`` is a row a line, by one ``posexplode``,
and ``entries`` is a file's directives as an array in the file's row.  No
shuffle, no user function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgate.functions.latin1 import from_bytes, let, to_text, trim

#: Spellings of each directive (fixed values).
KEYWORDS = {
    "user_agent": ("user-agent", "user agent", "useragent"),
    "allow": ("allow",),
    "disallow": ("disallow", "dissallow", "dissalow", "disalow", "diasllow", "disallaw"),
    "sitemap": ("sitemap", "site-map", "site map"),
    "crawl_delay": ("crawl-delay", "crawl delay", "crawldelay"),
}
_NAMES = "|".join(w for words in KEYWORDS.values() for w in words)
STATEMENT = rf"(?i)^[ \t]*({_NAMES})(?:[ \t]*:|[ \t]+)([^#]*)"
#: Numbers that a crawl delay may be written as.
_FLOAT = r"(?i)^[+-]?(?:inf|infinity|nan|[0-9]+(?:\.[0-9]*)?(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?)\z"


def text_lines(content: Column, max_bytes: int | None = None) -> Column:
    """The lines of a binary file, as Latin-1 text without their ends."""
    body = content if max_bytes is None else F.substring(content, 1, max_bytes)
    text = F.regexp_replace(F.translate(from_bytes(body), "\x00", "\n"), "^ï?»?¿?", "")
    parts = F.split(text, "\r+\n?|\n", -1)
    # A file that ends in a line break, or is empty, has no line after it.
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(robots: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``robots_id``, ``line_no`` from 0, ``line``."""
    return robots.select("robots_id", F.posexplode(text_lines(F.col("content"), max_bytes)).alias("line_no", "line"))


def lexed(line: Column) -> Column:
    """A line as a struct of ``kind``, ``value`` (Latin-1) and ``delay``."""

    def read(word: Column) -> Column:
        kind = F.lit("raw")
        for name, words in KEYWORDS.items():
            kind = F.when(word.isin(*words), name).otherwise(kind)
        # Most lines are no more than one search; a statement takes a second one.
        rest = F.struct(kind.alias("kind"), trim(F.regexp_extract(line, STATEMENT, 2)).alias("text"))
        return F.when(word == "", raw).otherwise(let(rest, judged))

    def judged(x: Column) -> Column:
        kind, text = x["kind"], x["text"]
        number = F.when(kind == "crawl_delay", F.when(text.rlike(_FLOAT), text.try_cast("float")))
        # A delay that is no number is an unknown line; an empty Disallow allows all.
        delay = let(number, lambda n: F.when(n.isNull() | F.isnan(n) | (n < 0), raw).otherwise(entry(kind, text, n)))
        return F.when(kind == "crawl_delay", delay).when((kind == "disallow") & (text == ""), entry(F.lit("allow"), F.lit("/"))).otherwise(entry(kind, text))

    def entry(kind: Column, value: Column, delay: Column | None = None) -> Column:
        return F.struct(kind.alias("kind"), value.alias("value"), (F.lit(None).cast("float") if delay is None else delay).alias("delay"))

    raw = entry(F.lit("raw"), line)
    return let(F.lower(F.regexp_extract(line, STATEMENT, 1)), read)


def directives(robots: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``robots_id``, ``line_no``, ``kind``, ``value`` (Latin-1) and ``delay`` of every line."""
    return lines(robots, max_bytes).select("robots_id", "line_no", F.inline(F.array(lexed(F.col("line")))))


def entries(content: Column, max_bytes: int | None = None) -> Column:
    """A file's directives in order: structs of ``line_no``, ``kind``, ``value`` and ``delay``; unknown lines are left out."""

    def numbered(line: Column, i: Column) -> Column:
        return let(lexed(line), lambda e: F.when(e["kind"] != "raw", F.struct(i.alias("line_no"), e["kind"].alias("kind"), e["value"].alias("value"), e["delay"].alias("delay"))))

    return F.filter(F.transform(text_lines(content, max_bytes), numbered), lambda e: e.isNotNull())


def debug_lines(parsed: DataFrame) -> DataFrame:
    """Directives as one line of JSON each, for people."""
    return parsed.select("robots_id", "line_no", F.to_json(F.struct("kind", F.coalesce(to_text(F.col("value")), F.col("value")).alias("value"), "delay")).alias("debug"))
