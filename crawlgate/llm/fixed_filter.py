"""Filters of fixed size that hold a set of numbers, and some others, on every executor.

They only save work: what a filter holds is then looked at in full, so a
filter that is too full costs time and changes no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 32-bit words that one row brings to the driver.
_CHUNK = 2048


def made(numbers: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` bits for the numbers of the one column.

    Words are made by executors, joined to chunks there, and only whole chunks
    are sent: as many bytes as the filter has, at any size of the input.
    """
    (name,) = numbers.columns
    h = F.pmod(F.col(name), F.lit(bits))
    words = numbers.select(h.alias("h")).selectExpr("shiftright(h, 5) AS w", "shiftleft(1L, CAST(h % 32 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        chunk, at = np.divmod(group["w"].to_numpy(np.int64), _CHUNK)
        part = np.zeros(_CHUNK, np.uint32)
        part[at] = group["b"].to_numpy(np.int64).astype(np.uint32)
        return pd.DataFrame({"chunk": chunk[:1], "part": [part.tobytes()]})

    out = np.zeros((bits // 32 // _CHUNK, _CHUNK), np.uint32)
    for r in words.groupBy(F.floor(F.col("w") / _CHUNK)).applyInPandas(joined, "chunk long, part binary").toLocalIterator():
        out[r["chunk"]] = np.frombuffer(r["part"], np.uint32)
    return out.ravel()


def held(filter_: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each number; true for all that it was made of."""
    at = numbers % (32 * len(filter_))
    return (filter_[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)


def holds(spark: SparkSession, filter_: np.ndarray):
    """``held`` as a column function."""
    sent = spark.sparkContext.broadcast(filter_)

    @F.pandas_udf("boolean")
    def check(numbers: pd.Series) -> pd.Series:
        return pd.Series(held(sent.value, numbers.to_numpy(np.int64)), index=numbers.index)

    return check
