"""Governance of model versions and thresholds: adjustments, guardrails, actions, lineage, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import bernoulli_kl
from . import ranges


def adjusted_confidence(metrics: DataFrame, start: float = 0.6) -> DataFrame:
    """Confidence floor after each rule in turn, kept in [0.5, 0.9] and rounded after each."""
    c: Column = F.lit(start)
    for hit, step in ((F.col("win_rate") < 0.5, 0.03), (F.col("sharpe") < 0.0, 0.03), (F.abs("max_drawdown") > 0.2, 0.05), ((F.col("win_rate") > 0.6) & (F.col("sharpe") > 1.0), -0.02)):
        c = F.when(F.coalesce(hit, F.lit(False)), F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.5), c + step)), 2)).otherwise(c)
    return metrics.withColumn("conf_min", c)


def guardrails(proposals: DataFrame, applied: DataFrame, now: str, labels: int = 20, precision: float = 0.75, ece: float = 0.06, hours: int = 24) -> DataFrame:
    """Reasons against each proposed action; without any it is applied."""
    last = applied.groupBy("version").agg(F.max("ts").alias("last"))
    tests = [(F.col("labels") < labels, "labels"), (F.col("precision") < precision, "precision"), (F.col("ece") > ece, "ece"), (F.col("last") > F.expr(f"timestamp '{now}' - interval {hours} hour"), "cooldown")]
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))
    return proposals.join(last, "version", "left").select("version", "action", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("applied"))


def parents(versions: DataFrame) -> DataFrame:
    """Each version with the one before it and the difference in precision."""
    w = W.orderBy("pos")
    return versions.select("version", F.lag("version").over(w).alias("parent"), F.round(F.col("precision") - F.lag("precision").over(w), 6).alias("precision_delta"))


def actions(trends: DataFrame) -> DataFrame:
    """rollback, promote or observe from two trends, with a confidence by the number of reasons; the surest of each kept."""
    down, up = (F.col("precision_trend") == "declining"), (F.col("precision_trend") == "improving")
    worse, better = (F.col("ece_trend") == "worsening"), (F.col("ece_trend") == "improving")
    action = F.when(down & worse, "rollback").when(up & better, "promote").otherwise("observe")
    n = F.when(action == "rollback", 2).when(action == "promote", 2).otherwise(sum((c.cast("int") for c in (down, up, worse, better)), F.lit(0)))
    each = trends.select("version", action.alias("action"), F.least(F.lit(1.0), 0.5 + 0.2 * n).alias("confidence"))
    return each.groupBy("version", "action").agg(F.max("confidence").alias("confidence"))


def blue_green(pairs: DataFrame) -> DataFrame:
    df1, dece = F.col("f1_new") - F.col("f1_old"), F.col("ece_new") - F.col("ece_old")
    kind = F.when((df1 < -0.02) | (dece > 0.01), "rollback_risk").when((df1 >= 0.02) & (F.col("confidence") >= 0.8), "promote_ready").otherwise("observe")
    return pairs.select("version", F.round(df1, 6).alias("d_f1"), F.round(dece, 6).alias("d_ece"), kind.alias("kind"))


def drift_candidates(trend: DataFrame, key: str, ece: float = 0.06, n: int = 10, times: int = 3) -> DataFrame:
    """Keys with several bad buckets, and whether the last one is bad still (then retrain)."""
    bad = (F.col("ece") > ece) & (F.col("n") >= n)
    return trend.groupBy(key).agg(F.count_if(bad).alias("bad"), F.max_by(bad, "bucket").alias("retrain")).where(F.col("bad") >= times)


def threshold_decisions(current: DataFrame, proposed: DataFrame, support: DataFrame, labels: int, precision: float, delta: float) -> DataFrame:
    """Ordered guardrails over a full join of current and proposed thresholds and their support."""
    j = current.join(proposed, "origin", "full").join(support, "origin", "full")
    why = (
        F.when(F.col("threshold").isNull() | F.col("recommended").isNull(), "missing").when(F.coalesce("labels", F.lit(0)) < labels, "labels")
        .when(F.coalesce("precision", F.lit(0.0)) < precision, "precision").when(F.abs(F.col("recommended") - F.col("threshold")) > delta, "delta").otherwise("applied")
    )
    return j.select("origin", why.alias("decision"), F.when(why == "applied", F.col("recommended")).otherwise(F.col("threshold")).alias("threshold"))


def influence_edges(pairs: DataFrame, least_r: float = 0.3, most_p: float = 0.05) -> DataFrame:
    """Significant pairs, pointed from leader to follower by the lag's sign, weighted by |r| (1 - p)."""
    sure = pairs.where((F.abs("r") >= least_r) & (F.col("p") < most_p) & F.coalesce("significant", F.lit(True)))
    back = F.col("lag") < 0
    return sure.select(F.when(back, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("dst"), F.round(F.abs("r") * (1 - F.col("p")), 6).alias("w"))


def influence(edges: DataFrame) -> DataFrame:
    """Share of outgoing and of incoming weight of each node."""
    both = edges.select(F.col("src").alias("node"), F.col("w").alias("o"), F.lit(0.0).alias("i")).unionAll(edges.select("dst", F.lit(0.0), "w"))
    n = both.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    every = W.partitionBy()
    return n.select("node", F.round(F.try_divide(F.col("o"), F.sum("o").over(every)), 6).alias("influence"), F.round(F.try_divide(F.col("i"), F.sum("i").over(every)), 6).alias("sensitivity"))


def coverage(wide: DataFrame, features: list[str]) -> DataFrame:
    """Share of non-zero values, mean, population deviation and range of each feature, one row a feature."""
    long = wide.unpivot([], features, "feature", "value")
    return long.groupBy("feature").agg(
        F.round(100 * F.avg((F.col("value") != 0).cast("int")), 6).alias("nonzero_pct"), F.round(F.avg("value"), 9).alias("mean"), F.round(F.stddev_pop("value"), 9).alias("std"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def drift(before: DataFrame, after: DataFrame, n: int) -> DataFrame:
    """Features by how far mean and share of non-zero values have moved."""
    b = after.select("feature", F.col("mean").alias("mean_b"), F.col("nonzero_pct").alias("nz_b"))
    span = F.col("high") - F.col("low")
    span = F.when(span <= 1e-6, F.abs("mean") + 1).otherwise(span)
    score = F.abs(F.col("mean_b") - F.col("mean")) / span + 0.5 * F.abs(bernoulli_kl(F.col("nz_b") / 100, F.col("nonzero_pct") / 100))
    return before.join(b, "feature").select("feature", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "feature").limit(n)


def semver_order(versions: DataFrame) -> DataFrame:
    """Rows by n, then by the version's three numbers, largest first."""
    part = [F.coalesce(F.split("version", r"\.")[i].try_cast("int"), F.lit(0)) for i in range(3)]
    return versions.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), *[p.desc() for p in part], "version")))


def top_explanations(fired: DataFrame, first: int, n: int) -> DataFrame:
    """Most frequent among each row's first explanations, per origin."""
    e = fired.select("origin", F.posexplode("explanation").alias("i", "feature")).where(F.col("i") < first).groupBy("origin", "feature").agg(F.count("*").alias("n"))
    return e.withColumn("rank", F.row_number().over(W.partitionBy("origin").orderBy(F.desc("n"), "feature"))).where(F.col("rank") <= n)


def balanced(rows: DataFrame, ratio: int, key: str, label: str) -> DataFrame:
    """All of the rarer label and at most ratio times as many of the other, the first ones by hash."""
    r = F.md5(F.col(key).cast("string"))
    x = rows.withColumns({"__h": r, "__b": F.substring(r, 1, 3)})
    sizes = x.groupBy(F.col(label).alias("__l"), F.col("__b").alias("__p")).agg(F.count("*").alias("__n"))
    least = sizes.groupBy("__l").agg(F.sum("__n").alias("c")).agg(F.min("c").alias("__least"))
    before = W.partitionBy("__l").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n").join(F.broadcast(least))
    inside = F.row_number().over(W.partitionBy(label, "__b").orderBy("__h", key))
    x = x.withColumn("__i", inside).join(starts, F.col(label).eqNullSafe(F.col("__l")) & F.col("__b").eqNullSafe(F.col("__p")))
    return x.where(F.col("__start") + F.col("__i") <= ratio * F.col("__least")).select(*rows.columns)


def chronological(rows: DataFrame, share: float, *order: str) -> DataFrame:
    """part: the first share of each origin's rows is train, the rest test; order begins with a time."""
    placed = ranges.numbered(rows, "origin", *order)
    return placed.withColumn("part", F.when(F.col("__i") <= F.floor(F.col("__n") * share), "train").otherwise("test")).drop("__i", "__n")
