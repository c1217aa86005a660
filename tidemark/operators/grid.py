"""Time grids: zero-filled counts per origin and bucket, hourly resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import bucket


def counts(events: DataFrame, interval: str) -> DataFrame:
    """origin, bucket, n."""
    return events.groupBy("origin", bucket(F.col("ts"), interval).alias("bucket")).agg(F.count("*").alias("n"))


def grid(origins: DataFrame, start: str, end: str, interval: str) -> DataFrame:
    """Every origin with every bucket from start to before end."""
    last = F.expr(f"timestamp '{end}' - interval 1 {interval}")
    return origins.select("origin", F.explode(F.sequence(F.lit(start).cast("timestamp"), last, F.expr(f"interval 1 {interval}"))).alias("bucket"))


def densified(events: DataFrame, start: str, end: str, interval: str) -> DataFrame:
    """Counts with zeros for the buckets of the grid in which an origin has no event; the grid decides what counts."""
    have = counts(events, interval)
    return grid(events.select("origin").distinct(), start, end, interval).join(have, ["origin", "bucket"], "left").fillna(0, ["n"])


def hourly_bars(events: DataFrame, key: str = "symbol", price: str = "price") -> DataFrame:
    """symbol, ts (hour), open, high, low, close, volume of observed hours."""
    at = F.struct("ts", "event_id")
    return events.groupBy(key, F.date_trunc("hour", "ts").alias("ts")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("volume")
    )


def resampled(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """Every hour between a symbol's first and last with the last known close; open, high and low rebuilt from closes."""
    span = bars.groupBy(key).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    hours = span.select(key, F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("ts"))
    w = W.partitionBy(key).orderBy("ts")
    filled = hours.join(bars.select(key, "ts", "close", "volume"), [key, "ts"], "left")
    filled = filled.withColumn("close", F.last("close", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).fillna(0, ["volume"])
    before = F.coalesce(F.lag("close").over(w), F.col("close"))
    return filled.select(key, "ts", before.alias("open"), F.greatest(before, "close").alias("high"), F.least(before, "close").alias("low"), "close", "volume")
