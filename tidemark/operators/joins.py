"""Joins in time: nearest within a window, interval existence, lags, forward as-of.

Windows become equi-joins on time buckets as wide as the window, one side in its own bucket and the two next to it,
so that Spark shuffles by key and bucket and no key's rows meet as a whole.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a time range, and the most ranges that all keys' times are cut into.
RANGE_ROWS, RANGES = 1 << 16, 4096
#: Windows that a stretch of nearest() is wide; of right, one row in so many halves stands in two stretches.
STRETCH = 4


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def _bucketed(df: DataFrame, ts: str, width: int, spread: bool) -> DataFrame:
    own = F.floor(micros(F.col(ts)) / width)
    return df.withColumn("__b", F.explode(F.array(own - 1, own, own + 1)) if spread else own)


def within(left: DataFrame, right: DataFrame, key: str, seconds: int) -> DataFrame:
    """All pairs of left (with ts) and right (with r_ts) of equal key at most so many seconds apart."""
    width = seconds * 1_000_000
    a, b = _bucketed(left, "ts", width, True), _bucketed(right, "r_ts", width, False)
    return a.join(b, [key, "__b"]).where(F.abs(micros(F.col("ts")) - micros(F.col("r_ts"))) <= width).drop("__b")


def nearest(left: DataFrame, right: DataFrame, key: str, seconds: int, row: str) -> DataFrame:
    """For each row of left the nearest of right within the window, the earlier one if two are as near (then the smaller r_seq).

    left has ts and a unique column `row`; right has r_ts and r_seq. Rows without a match are left out. Both are sorted by
    key and stretch of time, once: a row meets the last one of right before it and the first one after it, however many
    are near, and those of right stand in each stretch that they may be near to.
    """
    width = seconds * 1_000_000
    stretch = lambda at: F.floor(at / (width * STRETCH))
    mine, others = [c for c in left.columns if c != key], [c for c in right.columns if c != key]
    at, r_at = micros(F.col("ts")), micros(F.col("r_ts"))
    a = left.where(F.col(key).isNotNull() & at.isNotNull()).select(F.col(key).alias("__k"), at.alias("__t"), stretch(at).alias("__b"), F.lit(True).alias("__left"), F.struct(*mine).alias("__l"))
    b = right.where(F.col(key).isNotNull() & r_at.isNotNull()).select(
        F.col(key).alias("__k"), r_at.alias("__t"), F.explode(F.sequence(stretch(r_at - width), stretch(r_at + width))).alias("__b"), F.lit(False).alias("__left"), F.col("r_seq").alias("__s"), F.struct(*others).alias("__r")
    )
    # plain columns, so that both steps below share one sort; of right's rows at one time only the first can be met
    one = W.partitionBy("__k", "__b").orderBy("__t", "__left", "__s")
    heads = a.unionByName(b, allowMissingColumns=True).withColumn("__r", F.when(F.coalesce(F.lag("__t").over(one) < F.col("__t"), F.lit(True)), F.col("__r")))
    found = heads.select(
        "__k", "__t", "__l", F.last("__r", ignorenulls=True).over(one.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("__before"),
        F.expr("lead(__r) ignore nulls over (partition by __k, __b order by __t, __left, __s)").alias("__after"),
    ).where("__l is not null")
    gap = {c: F.abs(F.col("__t") - micros(F.col(f"{c}.r_ts"))) for c in ("__before", "__after")}
    earlier = F.coalesce(gap["__before"] <= gap["__after"], F.col("__before").isNotNull())
    found = found.withColumn("__r", F.when(earlier, F.col("__before")).otherwise(F.col("__after")))
    found = found.where(F.abs(F.col("__t") - micros(F.col("__r.r_ts"))) <= width)
    found = found.select(F.col("__k").alias(key), *[F.col("__l")[c].alias(c) for c in mine], *[F.col("__r")[c].alias(c) for c in others])
    w = W.partitionBy(row).orderBy(F.abs(at - r_at), "r_ts", "r_seq")
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def exists_after(left: DataFrame, right: DataFrame, key: str, seconds: int, row: str) -> DataFrame:
    """left with `found`: whether right has a row of equal key in (ts, ts + seconds]."""
    width = seconds * 1_000_000
    own = F.floor(micros(F.col("ts")) / width)
    probes = left.select(row, key, "ts", F.explode(F.array(own, own + 1)).alias("__b"))
    hits = probes.join(_bucketed(right.select(key, "r_ts"), "r_ts", width, False), [key, "__b"])
    hits = hits.where((F.col("r_ts") > F.col("ts")) & (micros(F.col("r_ts")) <= micros(F.col("ts")) + width)).select(row).distinct()
    return left.join(hits.withColumn("found", F.lit(True)), row, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def lagged(a: DataFrame, b: DataFrame, on: list[str], step_s: int, lags: int) -> DataFrame:
    """a(bucket) joined to b(bucket + lag * step) for lags -n..n where both exist."""
    shifted = a.withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags))))
    shifted = shifted.withColumn("b_bucket", F.timestamp_micros(micros(F.col("bucket")) + F.col("lag") * F.lit(step_s * 1_000_000)))
    return shifted.join(b.withColumnRenamed("bucket", "b_bucket"), [*on, "b_bucket"])


def time_cuts(times: DataFrame, ts: str, rows: int = RANGE_ROWS, most: int = RANGES) -> list[float]:
    """Borders in microseconds that cut times into ranges of about so many rows; ranges grow once there are `most` of them."""
    at = times.select(micros(F.col(ts)).cast("double").alias("at"))
    n = min(at.count() // rows, most)
    return sorted(set(at.approxQuantile("at", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []


def ranged(df: DataFrame, ts: str, cuts: list[float]) -> DataFrame:
    """df with __b, the place of ts among the cuts; null times have a range of their own after all others."""
    if not cuts:
        return df.withColumn("__b", F.when(F.col(ts).isNull(), 1.0).otherwise(0.0))
    b = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__at", outputCol="__b", handleInvalid="keep")
    found = b.transform(df.withColumn("__at", micros(F.col(ts)).cast("double"))).drop("__at")
    return found.withColumn("__b", F.coalesce("__b", F.lit(len(cuts) + 1.0)))


def forward_asof(left: DataFrame, right: DataFrame, key: str, value: str, rows: int = RANGE_ROWS) -> DataFrame:
    """left with right's value at the first r_ts >= ts, else at its last: sorted by key and time range, never by key alone.

    Ranges without a later value take it from a table of one first and one last value a key and range. Of values at
    the same time the least is the first and the greatest the last; null values, times and keys of right are left out,
    and a null ts has the last value.
    """
    right = right.where(F.col(key).isNotNull() & F.col("r_ts").isNotNull() & F.col(value).isNotNull())
    right = right.select(key, F.col("r_ts").alias("ts"), F.col(value).alias("__r")).withColumn("__left", F.lit(False))
    both = left.drop(value).withColumn("__r", F.lit(None).cast(right.schema["__r"].dataType)).withColumn("__left", F.lit(True)).unionByName(right, allowMissingColumns=True)
    both = ranged(both, "ts", time_cuts(both, "ts", rows))
    at = F.when(~F.col("__left"), F.struct("ts", "__r"))
    later = W.partitionBy(key).orderBy(F.desc("__b"))
    edges = (
        both.groupBy(key, "__b").agg(F.min_by("__r", at).alias("__first"), F.max_by("__r", at).alias("__last"))
        .withColumn("__after", F.last("__first", ignorenulls=True).over(later.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("__end", F.first("__last", ignorenulls=True).over(later.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .select(key, "__b", F.coalesce("__after", "__end").alias("__else"))
    )
    # backwards in time, so that the frame only grows
    back = W.partitionBy(key, "__b").orderBy(F.desc("ts"), "__left", F.desc("__r")).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("__found", F.last("__r", ignorenulls=True).over(back)).where("__left").join(edges, [key, "__b"], "left")
    return found.withColumn(value, F.coalesce("__found", "__else")).select(*[c for c in left.columns if c != value], value)
