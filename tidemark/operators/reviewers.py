"""Reviewers, consensus, trust and suppression queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import weight_band
from ..functions.stats import safe_ratio


def scoring(actions: DataFrame) -> DataFrame:
    """Actions, mean delta and share of positive deltas of each reviewer."""
    return actions.groupBy("reviewer").agg(F.count("*").alias("actions"), F.round(F.avg("delta"), 4).alias("mean_delta"), F.round(100 * F.avg((F.col("delta") > 0).cast("int")), 2).alias("pct_positive"))


def weighted(flags: DataFrame, scores: DataFrame) -> DataFrame:
    """The flag's own weight, else its reviewer's score in a band."""
    return flags.join(scores.select("reviewer", F.col("score").alias("__s")), "reviewer", "left").withColumn("weight", F.coalesce("weight", weight_band(F.col("__s")))).drop("__s")


def consensus(flags: DataFrame, threshold: float = 2.5) -> DataFrame:
    """First flag of each reviewer on a signal counts; weights add up to the threshold or not; last time over all flags."""
    w = W.partitionBy("signal", "reviewer").orderBy("ts", "seq")
    first = flags.withColumn("i", F.row_number().over(w))
    return first.groupBy("signal").agg(
        F.round(F.sum(F.when(F.col("i") == 1, F.col("weight"))), 6).alias("total_weight"), F.count_if(F.col("i") == 1).alias("reviewers"), F.max("ts").alias("last_flagged")
    ).withColumn("triggered", F.col("total_weight") >= threshold)


def leaderboard(scores: DataFrame, n: int) -> DataFrame:
    """Latest score of each reviewer, heaviest first."""
    last = scores.groupBy("reviewer").agg(F.max_by("score", F.struct("ts", "seq")).alias("score"))
    return last.withColumn("weight", weight_band(F.col("score"))).orderBy(F.desc("weight"), F.coalesce("score", F.lit(-1.0)).desc(), "reviewer").limit(n)


def anomalies(scores: DataFrame, least: float, drop: float = -0.15) -> DataFrame:
    """Reviewers whose last score is low or fell at least so far from the one before."""
    w = W.partitionBy("reviewer").orderBy("ts", "seq")
    back = W.partitionBy("reviewer").orderBy(F.desc("ts"), F.desc("seq"))
    last = scores.withColumn("change", F.round(F.col("score") - F.lag("score").over(w), 6)).withColumn("i", F.row_number().over(back)).where("i = 1")
    return last.where((F.col("score") < least) | (F.col("change") <= drop)).select("reviewer", "score", "change")


def score_trend(scores: DataFrame) -> DataFrame:
    at = F.struct("ts", "seq")
    return scores.groupBy("reviewer").agg(F.count("*").alias("points"), F.round(F.max_by("score", at) - F.min_by("score", at), 6).alias("trend"))


def last_action(actions: DataFrame) -> DataFrame:
    """The inverse of each signal's and reviewer's last action: what a rollback adds."""
    w = W.partitionBy("signal", "reviewer", "action").orderBy(F.desc("ts"), F.desc("seq"))
    return actions.withColumn("i", F.row_number().over(w)).where("i = 1").select("signal", "reviewer", "action", F.round(-(F.col("weight") * F.col("delta")), 6).alias("inverse_delta"))


def status_summary(queue: DataFrame) -> DataFrame:
    """Counts and mean impact by status, by hint and over all, in one pass of grouping sets."""
    return queue.groupingSets([["status"], ["hint"], []], "status", "hint").agg(F.count("*").alias("n"), F.round(F.avg("impact"), 4).alias("mean_impact"), F.grouping_id().cast("int").alias("level"))


def patterns(queue: DataFrame, n: int) -> DataFrame:
    g = queue.groupBy("label", "status", "hint").agg(F.count("*").alias("n"), F.round(F.avg("trust"), 6).alias("avg_trust"), F.round(F.avg("impact"), 6).alias("avg_impact"))
    return g.withColumn("priority", F.round((1 - F.col("avg_trust")) * F.col("avg_impact"), 6)).orderBy(F.desc("priority"), "label", "status", "hint").limit(n)


def timeline(queue: DataFrame, top: int = 3) -> DataFrame:
    """Per day: rows, low-trust rows, mean trust and the most frequent labels."""
    day = F.to_date("ts").alias("day")
    n = queue.groupBy(day).agg(F.count("*").alias("n"), F.count_if(F.col("trust") < 0.4).alias("suppressed"), F.round(F.avg("trust"), 6).alias("avg_trust"))
    by = queue.groupBy(day, "label").agg(F.count("*").alias("c"))
    w = W.partitionBy("day").orderBy(F.desc("c"), "label")
    best = by.withColumn("i", F.row_number().over(w)).where(F.col("i") <= top).groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda x: x["label"]), ",").alias("top_labels"))
    return n.join(best, "day")


def impact(queue: DataFrame, seconds: int = 86400) -> DataFrame:
    """Action weight times distrust, plus a little where at least two others of the asset fall into the day before."""
    w = W.partitionBy("asset").orderBy(F.unix_seconds("ts")).rangeBetween(-seconds, 0)
    near = F.count("*").over(w) - 1
    return queue.withColumn("impact_score", F.round(F.col("action_weight") * (1 - F.col("trust")) + F.when(near >= 2, 0.1).otherwise(0.0), 3))


def asset_pulse(queue: DataFrame) -> DataFrame:
    at = F.struct("ts", "seq")
    change = F.max_by("trust", at) - F.min_by("trust", at)
    trend = F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")
    return queue.groupBy("asset").agg(F.count("*").alias("n"), F.round(F.avg("trust"), 6).alias("avg_trust"), trend.alias("trend"))


def trust_spikes(queue: DataFrame, start: str, end: str, threshold: float) -> DataFrame:
    """Assets whose mean trust differs between the window's halves; the midpoint is in both, an empty half counts 0."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    mid = F.timestamp_seconds((F.unix_seconds(a) + F.unix_seconds(b)) / 2)
    g = queue.where(F.col("ts").between(a, b)).groupBy("asset").agg(F.coalesce(F.avg(F.when(F.col("ts") <= mid, F.col("trust"))), F.lit(0.0)).alias("x"), F.coalesce(F.avg(F.when(F.col("ts") >= mid, F.col("trust"))), F.lit(0.0)).alias("y"))
    return g.where(F.abs(F.col("y") - F.col("x")) >= threshold).select("asset", F.round("x", 6).alias("first_half"), F.round("y", 6).alias("second_half"))


def feedback_volatility(feedback: DataFrame) -> DataFrame:
    y = F.col("label").cast("int")
    return feedback.groupBy("origin").agg(F.count("*").alias("n"), F.round(F.avg(1 - y), 6).alias("disagree_rate"), F.round(F.avg(y), 6).alias("mean"), F.round(F.stddev_samp(y), 6).alias("stdev"))


def feedback_summary(feedback: DataFrame, n: int) -> DataFrame:
    """Most disagreed keys, with the share that agrees."""
    g = feedback.groupBy("origin").agg(F.count("*").alias("total"), F.count_if(~F.col("label")).alias("disagree"))
    return g.withColumn("agree_pct", F.round(100 * safe_ratio(F.col("total") - F.col("disagree"), F.col("total")), 2)).orderBy(F.desc("disagree"), "origin").limit(n)


def retrain_summary(queue: DataFrame) -> DataFrame:
    return queue.groupBy("asset", "hint").agg(F.count("*").alias("n"))


def enriched(history: DataFrame, **sides: DataFrame) -> DataFrame:
    """Each asset of history with the number of its rows in every other table, each table counted before the join."""
    out = history.groupBy("asset").agg(F.count("*").alias("history"))
    for name, side in sides.items():
        out = out.join(side.groupBy("asset").agg(F.count("*").alias(name)), "asset", "left").fillna(0, [name])
    return out


def adjusted(scored: DataFrame, p: float = 0.7) -> DataFrame:
    """Confidence of rows that a model expects to be disagreed with: less 0.1 (not below 0), and times 0.9."""
    hit = F.col("p") > p
    return scored.withColumn("less", F.round(F.when(hit, F.greatest(F.col("confidence") - 0.1, F.lit(0.0))).otherwise(F.col("confidence")), 9)).withColumn("scaled", F.round(F.when(hit, F.col("confidence") * 0.9).otherwise(F.col("confidence")), 9))
