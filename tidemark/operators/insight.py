"""Figures over scored signals and feedback: trends, simulations, fitted thresholds, live backtests, rankings, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import safe_ratio
from . import joins, quality, ranges


def trend_deltas(scores: DataFrame, now: str, hours: tuple[int, ...] = (6, 24)) -> DataFrame:
    """asset, trend_{h}h: the last score less that nearest to now - h hours; the earlier row if two are as near.

    scores: asset, ts, seq, score, confidence. A score of zero or null gives way to the confidence.
    """
    value = F.coalesce(F.nullif("score", F.lit(0.0)), F.col("confidence"), F.lit(0.0))
    at = F.unix_micros("ts")
    latest = F.max_by(value, F.struct("ts", "seq"))
    near = {f"trend_{h}h": F.min_by(value, F.struct(F.abs(at - F.unix_micros(F.expr(f"timestamp '{now}' - interval {h} hour"))), "ts", "seq")) for h in hours}
    return scores.where("ts is not null").groupBy("asset").agg(*[F.round(latest - v, 4).alias(name) for name, v in near.items()])


def simulate_threshold(feedback: DataFrame, least: float) -> DataFrame:
    """Per asset: feedback, mean confidence, and rows that a threshold would adjust: sure enough and not agreed with."""
    sure = F.coalesce((F.col("confidence") >= least) & ~F.col("agree"), F.lit(False))
    return feedback.groupBy("asset").agg(F.count("*").alias("total_feedback"), F.count_if(sure).alias("adjusted_signals"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))


def agreement(feedback: DataFrame, key: str) -> DataFrame:
    """Agreeing and disagreeing rows of each signal and their rate; rows that say neither do not count."""
    yes, no = F.count_if(F.col("agree")), F.count_if(~F.col("agree"))
    return feedback.groupBy(key).agg((yes + no).alias("num_feedback"), yes.alias("num_agree"), no.alias("num_disagree"), F.round(F.try_divide(yes, yes + no), 6).alias("agreement_rate"))


def top_by_sum(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n keys with the largest sums, by name where they tie."""
    return rows.groupBy(key).agg(F.round(F.sum(value), 6).alias("total")).orderBy(F.desc("total"), key).limit(n)


def ordered_by(rows: DataFrame, column: str, descending: bool, key: str) -> DataFrame:
    """rows (one an asset) with their place by one column, null as 0, then by key."""
    value = F.coalesce(F.col(column), F.lit(0))
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.desc(value) if descending else F.asc(value), key)))


def feedback_digest(labels: DataFrame, n: int = 3) -> DataFrame:
    """Per class of label: rows, mean score, and the latest n rows' ids over all classes, newest first."""
    last = labels.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("ts")).alias("t"), (-F.col("event_id")).alias("i")))).alias("x"))
    ids = last.select(F.array_join(F.transform("x", lambda r: (-r["i"]).cast("string")), ",").alias("latest"))
    each = labels.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 4).alias("mean_score"))
    return each.join(ids)


def hourly_labels(scored: DataFrame, triggers: DataFrame, hours: int = 6) -> DataFrame:
    """scored (origin, bucket, p) with label: whether the origin has a trigger within so many hours after the bucket."""
    left = scored.withColumn("row", F.concat_ws("|", "origin", F.unix_micros("bucket"))).withColumn("ts", F.col("bucket"))
    right = triggers.select("origin", F.col("ts").alias("r_ts"))
    return joins.exists_after(left, right, "origin", hours * 3600, "row").select("origin", "bucket", "p", F.col("found").alias("label"))


def live_backtest(scored: DataFrame, triggers: DataFrame, threshold: float, hours: int = 6) -> DataFrame:
    """Counts, precision and recall of hourly scores per origin and over all ('overall')."""
    x = hourly_labels(scored, triggers, hours).withColumn("yes", F.col("p") >= threshold)
    counts = {"tp": F.col("yes") & F.col("label"), "fp": F.col("yes") & ~F.col("label"), "fn": ~F.col("yes") & F.col("label"), "tn": ~F.col("yes") & ~F.col("label")}
    each = x.groupBy("origin").agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    every = each.unionByName(each.agg(F.lit("overall").alias("origin"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in counts]))
    p, r = (F.round(safe_ratio(F.col("tp"), F.col("tp") + F.col(k)), 3) for k in ("fp", "fn"))
    return every.select("origin", *counts, p.alias("precision"), r.alias("recall"))


def fitted_thresholds(scored: DataFrame, triggers: DataFrame, targets: dict[str, float], least: int = 40, least_each: int = 3, hours: int = 6) -> DataFrame:
    """Per origin the smallest cutoff that reaches each precision; origins with too few hours, or of a class, are left out."""
    x = hourly_labels(scored, triggers, hours).withColumn("score", F.col("p"))
    n = x.groupBy("origin").agg(F.count("*").alias("n"), F.count_if("label").alias("y"))
    found = n.where((F.col("n") >= least) & (F.col("y") >= least_each) & (F.col("n") - F.col("y") >= least_each)).select("origin")
    for name, target in targets.items():
        found = found.join(quality.precision_threshold(x, target).withColumnRenamed("threshold", name), "origin", "left")
    return found


def last_label_join(decisions: DataFrame, labels: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """decisions with the last label of their id, both within [start, end]."""
    inside = F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    last = labels.where(inside).groupBy(key).agg(F.max_by("label", F.struct("ts", "event_id")).alias("label"))
    return decisions.where(inside).join(last, key)


def mentioned(signals: DataFrame, lines: DataFrame, key: str, line: str, pattern: str) -> DataFrame:
    """signals whose id stands in some line: ids are taken out of the lines by pattern, so that the join is one by equality."""
    found = lines.select(F.explode(F.regexp_extract_all(line, F.lit(pattern), F.lit(0))).alias(key)).distinct()
    return signals.join(found, key, "left_semi")


def cross_origin_cut(values: DataFrame, q: float, value: str = "n") -> DataFrame:
    """bucket, cut: of each bucket's values over the origins the one at place floor(q * (n - 1))."""
    w = W.partitionBy("bucket")
    x = values.withColumn("i", F.row_number().over(w.orderBy(value, "origin"))).withColumn("m", F.count("*").over(w))
    return x.where(F.col("i") == F.floor(F.lit(q) * (F.col("m") - 1)) + 1).select("bucket", F.col(value).alias("cut"))


def social_series(counts: DataFrame, window: int = 720, least: int = 24, lag: int = 1, scale: float = 1.0, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """bucket, social_score: each origin's dense hourly n as a rolling z clipped to 3, spread over [0, 1] and squashed, then the origins' mean, lag hours later.

    An origin whose z says nothing is spread by its counts; one of equal counts is 0.5. Hours without a score are 0.5.
    """
    own = W.partitionBy("origin")
    last = own.orderBy("bucket").rowsBetween(-(window - 1), 0)
    z = F.when(F.count("n").over(last) >= least, F.try_divide(F.col("n") - F.avg("n").over(last), F.nullif(F.stddev_pop("n").over(last), F.lit(0.0))))
    x = counts.withColumn("z", F.round(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z)), 9)).withColumn("z", F.when(z.isNotNull(), F.col("z")))

    def spread(c: str) -> Column:
        lo, hi = F.min(c).over(own), F.max(c).over(own)
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo))

    flat = F.coalesce(F.min("z").over(own) == F.max("z").over(own), F.lit(True))
    x = x.withColumn("s", F.when(flat, F.coalesce(spread("n"), F.lit(0.5))).otherwise(spread("z"))).withColumn("s", F.col("s") * (high - low) + low)
    mean = x.groupBy("bucket").agg(F.coalesce(F.avg("s"), F.lit(0.5)).alias("s"))
    moved = mean.select((F.col("bucket") + F.expr(f"interval {lag} hour")).alias("bucket"), F.col("s").alias("moved"))
    return mean.join(moved, "bucket", "left").select("bucket", F.round(F.col("moved") * scale, 6).alias("social_score"))


def fresh_or(cached: DataFrame, other: DataFrame, now: str, lookback: int, key: str = "symbol") -> DataFrame:
    """The last lookback days of each key's cached prices if these reach a day further back than that, else of its other ones."""
    first = cached.groupBy(key).agg(F.min("ts").alias("first"))
    fresh = first.where(F.col("first") <= F.expr(f"timestamp '{now}' - interval {lookback + 1} day")).select(key)
    since = F.col("ts") >= F.expr(f"timestamp '{now}' - interval {lookback} day")
    return cached.join(fresh, key, "left_semi").where(since).unionByName(other.join(fresh, key, "left_anti").where(since))


def synthetic_prices(symbols: DataFrame, now: str, days: int, key: str = "symbol") -> DataFrame:
    """symbol, ts, close: hourly prices about 100 that depend on the symbol and the hour alone, up to now."""
    hours = F.explode(F.expr(f"sequence(timestamp '{now}' - interval {days} day, timestamp '{now}', interval 1 hour)"))
    x = symbols.select(key).distinct().select(key, hours.alias("ts"))
    step = F.conv(F.substring(F.md5(F.concat_ws("|", key, F.unix_seconds("ts").cast("string"))), 1, 6), 16, 10).cast("double") / 0xFFFFFF
    return x.withColumn("close", F.round(100 + 10 * F.sin(F.unix_seconds("ts") / 86400.0) + step, 6))


def backfilled(rows: DataFrame, have: DataFrame, keys: list[str], score: Column, tag: str, least: float) -> DataFrame:
    """Rows that have lacks, scored, tagged and gated: direction by the score, kept marks those sure enough."""
    new = rows.join(have.select(*keys).distinct(), keys, "left_anti").withColumn("score", F.round(score, 6))
    side = F.when(F.col("score") >= 0.5, "long").otherwise("short")
    return new.select(*keys, "score", side.alias("direction"), F.lit(tag).alias("tag"), (F.greatest("score", 1 - F.col("score")) >= least).alias("kept"))


def failure_alerts(failures: DataFrame, every: int = 10) -> DataFrame:
    """Of each component every so manieth failure, with how many there have been."""
    return ranges.numbered(failures, "component", "ts", "event_id").withColumnRenamed("__i", "n").where(F.col("n") % every == 0).select("component", "event_id", "n")


def ranking_metrics(scored: DataFrame, key: str, p: str = "p", label: str = "label") -> DataFrame:
    """Per key: area under ROC (ties on a line), average precision (a step each cutoff), log-loss and Brier score; 0.5 and the base rate where a class is missing."""
    y = F.col(label).cast("int")
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(y * F.ln(q) + (1 - y) * F.ln(1 - q))
    cuts = scored.groupBy(key, F.col(p).alias("cut")).agg(F.sum(y).alias("t"), F.count("*").alias("m"), F.sum(loss).alias("loss"), F.sum((F.col(p) - y) ** 2).alias("sq"))
    w, all_ = W.partitionBy(key).orderBy(F.desc("cut")).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(key)
    x = cuts.withColumns({"tp": F.sum("t").over(w), "k": F.sum("m").over(w), "pos": F.sum("t").over(all_), "all": F.sum("m").over(all_)})
    f = F.col("m") - F.col("t")
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("all"))
    area = F.when(both, f * (F.col("tp") - F.col("t") / 2) / F.greatest(F.col("pos") * (F.col("all") - F.col("pos")), F.lit(1)))
    step = F.when(both, F.col("t") / F.greatest(F.col("pos"), F.lit(1)) * F.col("tp") / F.col("k"))
    mean = lambda c: F.sum(c) / F.sum("m")
    return x.groupBy(key).agg(
        F.round(F.coalesce(F.sum(area), F.lit(0.5)), 6).alias("roc_auc"), F.round(F.coalesce(F.sum(step), mean("t")), 6).alias("pr_auc"), F.round(mean("loss"), 6).alias("log_loss"), F.round(mean("sq"), 6).alias("brier")
    )
