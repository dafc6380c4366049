"""Rules: encoding, the three ways to match, and the decision among them.

Patterns with stars are matched by a fold over their parts, in time linear in
the URL for each part; no regular expression is built from a file's text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlgate.functions.latin1 import let, percent_encode, to_text

#: A pattern with "$" that is longer than this, stars in a row counted as one, is an error of its policy.
MAX_ANCHORED = 1024

RULE_TYPE = "struct<seq:int,pattern:string,mode:string,parts:array<string>,tail_ok:boolean,n:int,is_allowed:boolean>"


def compiled(seq: Column, value: Column, is_allowed: Column) -> Column:
    """A rule of a Latin-1 value; null if its bytes are not UTF-8."""
    return F.when(to_text(value).isNotNull(), let(percent_encode(value), lambda p: _rule(seq, p, is_allowed)))


def _rule(seq: Column, pattern: Column, is_allowed: Column) -> Column:
    anchored, starred = F.contains(pattern, F.lit("$")), F.contains(pattern, F.lit("*"))
    short = F.when(F.contains(pattern, F.lit("**")), F.regexp_replace(pattern, "[*]+", "*")).otherwise(pattern)
    head = F.when(anchored, F.regexp_extract(short, r"^([^$]*)", 1)).otherwise(short)
    # After the first "$" only stars and more "$" leave anything to match.
    tail_ok = ~anchored | F.regexp_extract(short, r"^[^$]*([\x00-\xff]*)", 1).rlike(r"^[$*]*$")
    return F.struct(
        seq.cast("int").alias("seq"),
        pattern.alias("pattern"),
        F.when(anchored, "regex").when(starred, "star").otherwise("prefix").alias("mode"),
        F.split(head, "[*]", -1).alias("parts"),
        tail_ok.alias("tail_ok"),
        F.length(pattern).alias("n"),
        is_allowed.alias("is_allowed"),
    )


def too_long(rule: Column, most: int = MAX_ANCHORED) -> Column:
    """Whether a rule is refused for its length."""
    return (rule["mode"] == "regex") & (F.length(F.regexp_replace(rule["pattern"], "[*]+", "*")) > most)


def effective(rule: Column) -> Column:
    """The pattern as it is matched: stars in a row as one."""
    return F.when(rule["mode"] == "prefix", rule["pattern"]).otherwise(F.regexp_replace(rule["pattern"], "[*]+", "*"))


def _found(parts: Column, text: Column, begin: Column) -> Column:
    """Where the text goes on after the parts, each found leftmost after the one before; 0 if one is missing."""
    return F.aggregate(
        parts,
        begin,
        lambda at, p: F.when((at == 0) | (p == ""), at).otherwise(_after(F.call_function("locate", p, text, at), p)),
    )


def _after(at: Column, part: Column) -> Column:
    return F.when(at > 0, at + F.length(part)).otherwise(0)


def matches(rule: Column, text: Column) -> Column:
    """Whether a rule matches a prepared URL."""
    parts = rule["parts"]
    first, n = F.get(parts, 0), F.size(parts)
    begin = F.length(first) + 1
    # Most rules fail at their first part, before any fold over the others.
    starred = text.startswith(first) & (_found(F.slice(parts, 2, F.greatest(n - 1, F.lit(0))), text, begin) > 0)
    # A text that is empty or begins with a star is searched for the first part too.
    loose = (text == "") | text.startswith("*")
    star = F.when(loose, _found(parts, text, F.lit(1)) > 0).otherwise(starred)
    last = F.element_at(parts, -1)
    middle = F.array(_found(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), text, begin))
    ends = text.endswith(last) & F.exists(middle, lambda at: (at > 0) & (F.length(text) - F.length(last) + 1 >= at))
    anchored = rule["tail_ok"] & text.startswith(first) & F.when(n == 1, text == first).otherwise(ends)
    return F.when(rule["mode"] == "prefix", text.startswith(rule["pattern"])).when(rule["mode"] == "star", star).otherwise(anchored)


def decision(rules: Column, text: Column) -> Column:
    """The rule that decides: the longest that matches, Allow before Disallow; null if none does."""
    # Rules that the text does not begin like are dropped first, but for texts that are searched for the first part too.
    near = F.when((text == "") | text.startswith("*"), rules).otherwise(F.filter(rules, lambda r: text.startswith(F.get(r["parts"], 0))))
    found = F.filter(near, lambda r: matches(r, text))
    return F.array_max(F.transform(found, lambda r: F.struct(r["n"].alias("n"), r["is_allowed"].alias("is_allowed"), r["pattern"].alias("pattern"))))


def allowed(rules: Column, text: Column) -> Column:
    """Whether a prepared URL may be fetched; never null."""
    return F.when(text == "/robots.txt", True).otherwise(F.coalesce(decision(rules, text)["is_allowed"], F.lit(True)))
