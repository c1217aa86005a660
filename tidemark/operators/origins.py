"""Origins of flags and triggers: breakdown, trends, precision, yield, bursts, regimes, correlation, lead-lag, attention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import shared
from ..functions.scalars import bucket, regime_threshold
from ..functions.stats import pearson, safe_ratio
from . import grid, joins, quantiles


def breakdown(flags: DataFrame, triggers: DataFrame) -> DataFrame:
    """origin, n, pct of flags and triggers together."""
    n = flags.select("origin").unionAll(triggers.select("origin")).groupBy("origin").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 2))


def trends(flags: DataFrame, triggers: DataFrame, interval: str) -> DataFrame:
    both = flags.select("origin", "ts", F.lit(1).alias("f")).unionAll(triggers.select("origin", "ts", F.lit(0)))
    return both.groupBy("origin", bucket(F.col("ts"), interval).alias("bucket")).agg(F.sum("f").alias("flags_count"), F.sum(1 - F.col("f")).alias("triggers_count"))


def collapsed(trend: DataFrame) -> DataFrame:
    """One bucket an origin, named by its last."""
    return trend.groupBy("origin").agg(F.max("bucket").alias("bucket"), F.sum("flags_count").alias("flags_count"), F.sum("triggers_count").alias("triggers_count"))


def per_origin(flags: DataFrame, triggers: DataFrame) -> DataFrame:
    both = flags.select("origin", F.lit(1).alias("f")).unionAll(triggers.select("origin", F.lit(0)))
    return both.groupBy("origin").agg(F.sum("f").alias("flags"), F.sum(1 - F.col("f")).alias("triggers"))


def source_metrics(flags: DataFrame, triggers: DataFrame, min_count: int = 1) -> DataFrame:
    """precision = triggers / flags, recall = share of all triggers; origins with at least min_count rows."""
    n = per_origin(flags, triggers).withColumn("all", F.sum("triggers").over(W.partitionBy()))
    return n.where(F.col("flags") + F.col("triggers") >= min_count).select(
        "origin", "flags", "triggers", F.round(safe_ratio(F.col("triggers"), F.col("flags")), 2).alias("precision"), F.round(safe_ratio(F.col("triggers"), F.col("all")), 2).alias("recall")
    )


def source_yield(flags: DataFrame, triggers: DataFrame, min_events: int, alpha: float) -> DataFrame:
    """Trigger rate and share of triggers blended by alpha, and the budget of origins with enough flags."""
    n = per_origin(flags, triggers).where("flags > 0")
    rate, share = F.col("triggers") / F.greatest("flags", F.lit(1)), F.col("flags") / F.greatest(F.sum("flags").over(W.partitionBy()), F.lit(1))
    scored = n.withColumn("yield_score", alpha * rate + (1 - alpha) * share).withColumn("eligible", F.col("flags") >= min_events)
    total = F.sum(F.when(F.col("eligible"), F.col("yield_score"))).over(W.partitionBy())
    budget = F.when(F.col("eligible"), F.round(safe_ratio(100 * F.col("yield_score"), total), 1)).otherwise(0.0)
    return scored.select("origin", "flags", "triggers", F.round("yield_score", 6).alias("yield_score"), "eligible", budget.alias("budget_pct"))


def bursts(events: DataFrame, start: str, end: str, interval: str, threshold: float) -> DataFrame:
    """Buckets whose count is at least threshold population deviations over the origin's mean on the zero-filled grid."""
    w = W.partitionBy("origin")
    z = grid.densified(events, start, end, interval).withColumn("z", F.try_divide(F.col("n") - F.avg("n").over(w), F.stddev_pop("n").over(w)))
    return z.where(F.col("z") >= threshold).select("origin", "bucket", "n", F.round("z", 6).alias("z"))


def burst_lists(events: DataFrame, start: str, end: str, interval: str, threshold: float) -> DataFrame:
    """All origins, with the number of their bursts and the highest z."""
    found = bursts(events, start, end, interval, threshold).groupBy("origin").agg(F.count("*").alias("bursts"), F.max("z").alias("top"))
    return events.select("origin").distinct().join(found, "origin", "left").fillna(0, ["bursts"])


def volatility_regimes(events: DataFrame, start: str, end: str, interval: str, lookback: int, calm: float = 0.33, turbulent: float = 0.66) -> DataFrame:
    """Population deviation of each origin's last buckets, classed by nearest-rank cuts across origins."""
    last = W.partitionBy("origin").orderBy(F.desc("bucket"))
    vol = grid.densified(events, start, end, interval).withColumn("i", F.row_number().over(last)).where(F.col("i") <= lookback)
    vol = vol.groupBy("origin").agg(F.stddev_pop("n").alias("vol"))
    vol = shared.written(vol, "volatility")
    cuts = quantiles.exact(vol, [], "vol", {"low": calm, "high": turbulent}, "even")
    metric = F.round("vol", 6)
    regime = F.when(metric <= F.col("low"), "calm").when(metric >= F.col("high"), "turbulent").otherwise("normal")
    return vol.join(F.broadcast(cuts)).select("origin", metric.alias("vol"), regime.alias("regime"), regime_threshold(regime).alias("threshold"))


def correlations(events: DataFrame, interval: str) -> DataFrame:
    """Pearson of each two origins' counts over all buckets that any origin has; buckets without a count are zeros that are never made."""
    have = shared.written(grid.counts(events, interval).withColumn("n", F.col("n").cast("double")), "counts")
    buckets = have.agg(F.count_distinct("bucket").alias("m"))
    sums = have.groupBy("origin").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    a, b = (have.select("bucket", F.col("origin").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    met = a.join(b, "bucket").where("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("ab"))
    each = [sums.select(F.col("origin").alias(x), F.col("s").alias(f"s{x}"), F.col("q").alias(f"q{x}")) for x in "ab"]
    # the result has a row a pair; what zeros add to its sums is nothing but the number of buckets
    pairs = each[0].join(each[1], F.col("a") < F.col("b")).join(met, ["a", "b"], "left").fillna(0.0, ["ab"]).join(F.broadcast(buckets))
    var = F.sqrt(F.greatest(F.col("m") * F.col("qa") - F.col("sa") * F.col("sa"), F.lit(0.0))) * F.sqrt(F.greatest(F.col("m") * F.col("qb") - F.col("sb") * F.col("sb"), F.lit(0.0)))
    r = F.when(F.col("m") < 2, 0.0).otherwise(F.coalesce(F.try_divide(F.col("m") * F.col("ab") - F.col("sa") * F.col("sb"), var), F.lit(0.0)))
    return pairs.select("a", "b", F.round(r, 3).alias("r"))


def lead_lag(events: DataFrame, interval: str, max_lag: int, top: int = 20) -> DataFrame:
    """For each ordered pair of the busiest origins, the lag with the largest |r|; the most negative wins a tie."""
    have = grid.counts(events, interval)
    busy = have.groupBy("origin").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "origin").limit(top).select("origin")
    have = have.join(busy, "origin", "left_semi")
    b = have.select("bucket", F.col("origin").alias("b"), F.col("n").alias("nb"))
    step = 3600 if interval == "hour" else 86400
    pairs = joins.lagged(have.select("bucket", F.col("origin").alias("a"), F.col("n").alias("na")), b, [], step, max_lag).where("a <> b")
    r = pairs.groupBy("a", "b", "lag").agg(F.round(pearson(F.col("na").cast("double"), F.col("nb").cast("double")), 6).alias("r"), F.count("*").alias("n")).where("n >= 3")
    w = W.partitionBy("a", "b").orderBy(F.abs("r").desc(), "lag")
    best = r.withColumn("i", F.row_number().over(w)).where("i = 1 and r <> 0")
    leader = F.when(F.col("lag") > 0, F.col("a")).when(F.col("lag") < 0, F.col("b")).otherwise("tie")
    return best.select("a", "b", F.col("lag").cast("int").alias("best_lag"), "r", leader.alias("leader"))


def nowcast(flags: DataFrame, triggers: DataFrame, start: str, end: str, z_cap: float = 5.0, max_lag: int = 6, top: int = 10) -> DataFrame:
    """Attention now: last bucket's z, precision, leadership and regime in one score, ranked."""
    w = W.partitionBy("origin")
    z = grid.densified(flags, start, end, "hour").withColumn("z", F.try_divide(F.col("n") - F.avg("n").over(w), F.stddev_pop("n").over(w)))
    z = z.groupBy("origin").agg(F.max_by("z", "bucket").alias("z"))
    lead = lead_lag(flags, "hour", max_lag)
    lead = lead.where("leader = a").groupBy(F.col("a").alias("origin")).agg(F.max(F.abs("r")).alias("lead"))
    factor = F.when(F.col("regime") == "calm", 0.95).when(F.col("regime") == "turbulent", 1.05).otherwise(1.0)
    parts = z.join(source_metrics(flags, triggers).select("origin", "precision"), "origin", "left").join(lead, "origin", "left").join(volatility_regimes(flags, start, end, "hour", 72).select("origin", "regime"), "origin", "left")
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("z", F.lit(0.0)) / z_cap))
    score = 100 * (0.5 * clipped + 0.25 * F.coalesce("precision", F.lit(0.0)) + 0.15 * F.coalesce("lead", F.lit(0.0)) + 0.10 * (factor - 0.9) / 0.2)
    scored = parts.select("origin", F.round(score, 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "origin"))).where(F.col("rank") <= top)
