"""Language identification by compression with per-language dictionaries.

For each language a raw-content zstandard dictionary is made of labelled
texts.  A text is cut into chunks of ``CHUNK`` bytes, all of them are
compressed with each dictionary (of both, the words in lower case), and the
language of the smallest sum is predicted.  Cutting keeps the dictionary in use
through a long text, where the text's own beginning would else take its place.

What is bounded: a dictionary holds ``DICT_BYTES`` bytes at most, equal shares
of ``ROWS`` labelled rows of its language, or of all if there are fewer.  The
rows are the distinct texts first by hash; a row's share is taken from a place
in its text that its hash chooses, ``SHARE`` characters at most.  All
dictionaries together have ``MOST_BYTES`` bytes; if there are so many
languages that they would have more, all are smaller.  Texts to predict are
read whole.

Defined results: a null text or one without a letter is ``und`` with score 0
and is rejected.  Equal sums go to the language first in alphabetical order,
with score 0 and rejected.  Without any labelled text every row is ``und``.
Rows are handled alone; repeated rows and null ids need no rule.  Only the
columns named in the call are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlgate.llm.common import bucket_of, release, small_batches, table, written

DICT_BYTES = 112_000
ROWS = 400
#: Characters that a labelled row gives at most.
SHARE = 2800
CHUNK = 2048
LEVEL = 9
#: A prediction is rejected if the second smallest is nearer than both: bytes, and part of its size.
NARROW_BYTES, NARROW_PART = 2, 0.01
MOST_BYTES = 64_000_000
#: Languages whose limits may be broadcast; beyond it they are joined by a shuffle.
MOST_LANGUAGES = 100_000

_LETTER = regex.compile(r"\p{L}")
_BETWEEN = regex.compile(r"[^\p{L}\p{M}]+")


def plain(text: str) -> bytes:
    """What is compressed: the text's words in lower case, a blank between them."""
    return _BETWEEN.sub(" ", text.lower()).encode("utf-8", "replace")


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Raw dictionary content of each language, from a bounded sample of its rows.

    A count of distinct hashes tells below which hash to look for the first
    ``ROWS``, so what is shuffled is some ``8 * ROWS`` rows a language, whatever
    the table's size.
    """
    body, name = F.col(f"`{text}`"), F.col(f"`{lang}`")
    h = F.xxhash64(body)
    place = F.pmod(h, F.greatest(F.length(body) - SHARE + 1, F.lit(1)).cast("long")).cast("int") + 1
    rows = labelled.select(name.cast("string").alias("lang"), h.alias("h"), F.substring(body, place, F.lit(SHARE)).alias("part"), body.rlike(r"\p{L}").alias("able"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("able")).select("lang", "h", "part")
    part = F.least(F.lit(1.0), 8 * ROWS / F.greatest(F.col("n"), F.lit(1)))
    limits = written(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).select("lang", (-(2.0**63) + part * 2.0**64).alias("below")), "limits")
    few = limits.count() <= MOST_LANGUAGES
    near = rows.join(F.broadcast(limits) if few else limits, "lang").filter(F.col("h") <= F.col("below")).drop("below")
    first = Window.partitionBy("lang").orderBy("h")
    sample = near.dropDuplicates(["lang", "h"]).withColumn("k", F.row_number().over(first)).filter(F.col("k") <= ROWS)
    parts: dict[str, list[bytes]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["k"])):
        parts.setdefault(r["lang"], []).append(plain(r["part"]))
    size = min(DICT_BYTES, MOST_BYTES // max(1, len(parts)))
    return {name: b" ".join(x[: max(1, size // len(own) - 1)] for x in own) for name, own in parts.items()}


class Model:
    """Compressors of each language."""

    def __init__(self, dicts: dict[str, bytes]):
        self.names = sorted(dicts)
        self.coders = [self._coder(dicts[x]) for x in self.names]

    @staticmethod
    def _coder(content: bytes):
        learnt = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        learnt.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=learnt, write_checksum=False, write_content_size=False, write_dict_id=False)

    def sizes(self, body: bytes) -> list[int]:
        chunks = [body[i : i + CHUNK] for i in range(0, len(body), CHUNK)]
        return [sum(len(c.compress(x)) for x in chunks) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in 0 to 1, whether it is rejected."""
        if not text or not self.names or not _LETTER.search(text):
            return "und", 0.0, True
        sizes = self.sizes(plain(text))
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best = sizes[order[0]]
        second = sizes[order[1]] if len(order) > 1 else best * 2
        gap = second - best
        rejected = gap < NARROW_BYTES or gap < NARROW_PART * second
        return self.names[order[0]], (1 - 0.5**gap) * min(1.0, gap / (2 * NARROW_PART * second)), rejected


def predictor(spark: SparkSession, dicts: dict[str, bytes]):
    """A column function: text -> struct of ``lang``, ``score``, ``rejected``."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(dicts)  # at most MOST_BYTES

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(sent.value)
        for batch in batches:
            yield pd.DataFrame([model.predict(x) for x in batch], columns=["lang", "score", "rejected"])
        del model
        release()

    return predict


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows whose language is never learnt from."""
    return F.coalesce(bucket_of(doc_id, 4) == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the language of every document, learnt outside the held-out rows."""
    docs = table(spark, sf_dir, "documents")
    dicts = learn(docs.filter(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), predictor(spark, dicts)("text").alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"))
