"""Quality rules: a threshold table compiled into one Spark projection.

``measured`` is one struct of counts of a text, ``compile_rules`` turns the
table below into one boolean expression over these counts, and both are plain
column expressions: no user function, no shuffle, no join.

Defined results: a null or empty text has no words, so all counts are 0 and
``base_failed`` is true.  Rows are judged alone, so ties, repeated rows, null
ids and empty tables need no rule.  Extra columns are passed through; a column
that is already called ``quality_rules`` is replaced.  Texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgate.llm.common import BLANKS, table

RESULT = "quality_rules"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``low <= 1000 * part / whole <= high`` for texts of ``min_words`` words or more."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    min_words: int = 1


#: Thresholds in thousandths, so that both sides stay whole numbers.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2000, high=12000),
    Rule("symbols", "n_symbols", "n_words", high=100),
    Rule("stop_words", "n_stop_words", "n_latin_words", low=20, min_words=50),
    Rule("upper_case_words", "n_upper_words", "n_words", high=500),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=500),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=300),
)

#: Frequent words of English, German, French and Spanish, then of Italian, Portuguese, Dutch, Swedish, Danish and
#: Norwegian, Polish, Czech, Finnish, Hungarian, Turkish, Romanian and Indonesian.  Only words with letters from A to Z are held
#: against them, so texts in other scripts are judged by the other rules.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the they this to was what which with you "
    "als auch auf das dem den der des die ein eine er es im ist mit nicht sich sie und von zu "
    "au avec ce dans de des du elle en est et il la le les ne pas pour par que qui se sur un une "
    "al con del el ella en es la las lo los no para por que se su un una y "
    "che di gli non per sono "
    "as com da do dos em mais não os uma "
    "aan dat een het met niet op te van voor zijn "
    "att av det för inte med och på som är "
    "af at blev og som til "
    "do jest na nie się to w z że "
    "byl do je na se ve že "
    "ei ja joka kun mutta on oli se "
    "az egy és hogy nem van "
    "bir bu çok da de için ile ve "
    "ce cu din este în pe și "
    "dan dengan di ini itu untuk yang"
).split()
STOP_WORDS = tuple(sorted(set(STOP_WORDS)))


_WINDOW_TYPE = "struct<a:string,b:string,c:string,d:string,e:string,at:int>"


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` made once.

    A named column would be inlined into the lambdas below and made again for
    each element; the variable of a lambda over an array of one is not.
    """
    return F.get(F.transform(F.array(value), then), 0)


def _windows(words: Column) -> Column:
    """Each run of five words, with its place."""
    n = F.size(words)
    made = F.transform(
        F.slice(words, 1, F.greatest(n - WINDOW + 1, F.lit(1))),
        lambda w, i: F.struct(w.alias("a"), *[F.get(words, i + k).alias(x) for k, x in enumerate("bcde", 1)], i.alias("at")),
    )
    return F.when(n >= WINDOW, made).otherwise(F.array().cast(f"array<{_WINDOW_TYPE}>"))


def _repeated_words(windows: Column) -> Column:
    """Words inside five-word windows that occur twice or more.

    Equal windows have equal hashes, so a text whose hashes all differ has
    none; only the others sort their windows, which compares the words.
    """

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]) & (x["d"] == y["d"]) & (x["e"] == y["e"]), F.lit(False))

    def covered(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, k: same(x, F.get(ordered, k - 1)) | same(x, F.get(ordered, k + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.sequence(x["at"], x["at"] + WINDOW - 1)))))

    hashes = F.transform(windows, lambda x: F.xxhash64(x["a"], x["b"], x["c"], x["d"], x["e"]))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(windows), _let(F.array_sort(windows), covered)).otherwise(0)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_repeat_words", "n_stop_words", "n_latin_words", "n_upper_words")


def _counts(text: Column, words: Column, lines: Column) -> Column:
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.regexp_replace(text, BLANKS, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))),
        "n_repeat_words": _let(_windows(words), _repeated_words),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_latin_words": F.size(F.filter(words, lambda w: w.rlike("[A-Za-z]"))),
        "n_upper_words": F.size(F.filter(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1))),
    }
    return F.struct(*[c.cast("long").alias(k) for k, c in counts.items()])


def measured(text: str = "text") -> Column:
    """A struct of the counts of a text, all long."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = lambda t: F.filter(F.split(t, BLANKS, -1), lambda w: w != "")
    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(F.struct(body.alias("t"), words(body).alias("w"), lines(body).alias("l")), lambda x: _counts(x["t"], x["w"], x["l"]))


def base_failed(m: Column) -> Column:
    """Under ten words, or over a fifth of the words in repeated windows."""
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def compile_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the table is broken."""
    verdict = F.lit(True)
    for rule in rules:
        part, whole = 1000 * m[rule.part], m[rule.whole]
        holds = F.lit(True)
        if rule.low is not None:
            holds = holds & (part >= rule.low * whole)
        if rule.high is not None:
            holds = holds & (part <= rule.high * whole)
        verdict = verdict & (holds | (m["n_words"] < rule.min_words))
    return verdict


def verdict(text: str = "text", rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the counts, ``base_failed`` and ``kept``."""

    def judged(m: Column) -> Column:
        failed = base_failed(m)
        return F.struct(*[m[c].alias(c) for c in COUNTS], failed.alias("base_failed"), (~failed & compile_rules(m, rules)).alias("kept"))

    return _let(measured(text), judged)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the struct ``quality_rules``: counts, ``base_failed``, ``kept``."""
    return docs.withColumn(RESULT, verdict(text, rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document of the table, judged."""
    docs = table(spark, sf_dir, "documents")
    # inline() makes the struct once; picking its fields could make it once a field.
    judged = docs.select("doc_id", F.inline(F.array(verdict())))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_rule(rule: Rule) -> str:
    holds = []
    if rule.low is not None:
        holds.append(f"1000 * {rule.part} >= {rule.low} * {rule.whole}")
    if rule.high is not None:
        holds.append(f"1000 * {rule.part} <= {rule.high} * {rule.whole}")
    return f"(({' AND '.join(holds)}) OR n_words < {rule.min_words})"


def measures_sql(docs: str = "documents") -> str:
    """DuckDB SQL of all counts, of ``base_failed`` and of ``kept``, with the columns of ``docs``."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
    WITH split_up AS (
      SELECT *, coalesce(text, '') AS body,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM {docs}
    ), windowed AS (
      SELECT *, list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4]) AS windows FROM split_up
    ), marked AS (
      SELECT *, list_filter(range(1, len(windows) + 1), lambda i: w_count[windows[i]] > 1) AS starts
      FROM (SELECT *, list_histogram(windows) AS w_count FROM windowed)
    ), counted AS (
      SELECT *,
        CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, chr(8230)))) AS BIGINT) AS n_ellipsis_lines,
        CAST(len(list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 5))))) AS BIGINT) AS n_repeat_words,
        CAST(len(list_filter(words, lambda w: lower(w) IN ({stops}))) AS BIGINT) AS n_stop_words,
        CAST(len(list_filter(words, lambda w: regexp_matches(w, '[A-Za-z]'))) AS BIGINT) AS n_latin_words,
        CAST(len(list_filter(words, lambda w: upper(w) = w AND lower(w) <> w AND length(w) > 1)) AS BIGINT) AS n_upper_words
      FROM marked
    ), failed AS (
      SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM counted
    )
    SELECT *, (NOT base_failed AND {" AND ".join(_sql_rule(r) for r in RULES)}) AS kept FROM failed
    """


ORACLE_SQL = f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
FROM ({measures_sql()})
"""
