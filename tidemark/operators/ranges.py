"""Figures in order of time within a key, by ranges of time: no window takes a key's rows as a whole.

All times are cut into ranges of about as many rows; a window runs inside a key and range, and what a range has to know of
the others comes from a table of one row a key and range. Rows without a time come last.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import joins


def _ranged(df: DataFrame, ts: str, rows: int) -> DataFrame:
    return joins.ranged(df, ts, joins.time_cuts(df, ts, rows))


def _with(x: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """x with the columns of edges (__e, __r, ...), a row a key and range."""
    return x.join(edges, F.col(key).eqNullSafe(F.col("__e")) & (F.col("__b") == F.col("__r"))).drop("__e", "__r")


def numbered(df: DataFrame, key: str, ts: str, *order: str, rows: int = joins.RANGE_ROWS) -> DataFrame:
    """df with __i, each row's place among its key's from 1, by ts and then order, and __n, how many there are."""
    x = _ranged(df, ts, rows)
    counts = x.groupBy(F.col(key).alias("__e"), F.col("__b").alias("__r")).agg(F.count("*").alias("__c"))
    line = W.partitionBy("__e")
    edges = counts.withColumn("__before", F.coalesce(F.sum("__c").over(line.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("__n", F.sum("__c").over(line)).drop("__c")
    x = x.withColumn("__i", F.row_number().over(W.partitionBy(key, "__b").orderBy(ts, *order)))
    return _with(x, key, edges).withColumn("__i", F.col("__i") + F.col("__before")).drop("__b", "__before")


def with_next(df: DataFrame, key: str, ts: str, order: list[str], value: str, name: str, rows: int = joins.RANGE_ROWS) -> DataFrame:
    """df with the value of each row's next one of its key, by ts and then order; null for the last."""
    x = _ranged(df, ts, rows)
    at = F.struct(ts, *order)
    firsts = x.groupBy(F.col(key).alias("__e"), F.col("__b").alias("__r")).agg(F.min_by(F.struct(F.col(value).alias("v")), at).alias("__first"))
    edges = firsts.withColumn("__after", F.lead("__first").over(W.partitionBy("__e").orderBy("__r"))).drop("__first")
    x = x.withColumn("__next", F.lead(F.struct(F.col(value).alias("v"))).over(W.partitionBy(key, "__b").orderBy(ts, *order)))
    return _with(x, key, edges).withColumn(name, F.coalesce("__next", "__after")["v"]).drop("__b", "__next", "__after")


def decayed(df: DataFrame, key: str, ts: str, value: str, share: float, name: str, rows: int = joins.RANGE_ROWS) -> DataFrame:
    """key, ts and an exponential mean: share * value + (1 - share) * the one before, from the first value on; null values are left out.

    Within a block of rows the mean is a sum of values times powers of 1 - share, kept in the range of doubles by the
    block's length; a block takes over from the one before by one power of its own length.
    """
    keep = 1 - share
    block = max(1, min(rows, int(200 / -math.log(keep)))) if keep > 0 else 1
    x = numbered(df.where(F.col(value).isNotNull()).select(key, ts, F.col(value).cast("double").alias("__x")), key, ts, rows=rows)
    x = x.withColumn("__b", F.floor((F.col("__i") - 1) / block)).withColumn("__j", (F.col("__i") - 1) % block)
    line = W.partitionBy(key, "__b").orderBy("__j").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("__s", F.sum(share * F.col("__x") * F.pow(F.lit(keep), -F.col("__j"))).over(line) * F.pow(F.lit(keep), F.col("__j")))
    blocks = x.groupBy(F.col(key).alias("__e"), F.col("__b").alias("__r")).agg(F.count("*").alias("m"), F.max_by("__s", "__j").alias("s"), F.min_by("__x", "__j").alias("first"))

    def carried(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__r")
        out, now = [], float(rows["first"].iloc[0])
        for m, s in zip(rows.m, rows.s, strict=True):
            out.append(now)
            now = keep**m * now + s
        return pd.DataFrame({"__e": rows["__e"], "__r": rows["__r"], "__carry": out})

    kind = df.schema[key].dataType.simpleString()
    carry = blocks.groupBy("__e").applyInPandas(carried, f"__e {kind}, __r long, __carry double")  # a row a key and block
    return _with(x, key, carry).select(key, ts, (F.col("__s") + F.pow(F.lit(keep), F.col("__j") + 1) * F.col("__carry")).alias(name))
