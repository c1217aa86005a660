"""Quality of decisions against labels: matching, confusion counts, calibration, thresholds, coverage, suppression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import banded
from ..functions.stats import f1, safe_ratio
from . import joins, quantiles

#: Rows of the chains that are matched in one call; a longer chain is one by itself.
GROUP_ROWS = 4096


def matched(labels: DataFrame, decisions: DataFrame, seconds: int = 300) -> DataFrame:
    """Each label with the nearest decision of its origin; decisions may serve many labels. ids: event_id and h_id."""
    right = decisions.select("origin", F.col("ts").alias("r_ts"), F.col("event_id").alias("r_seq"), *[c for c in decisions.columns if c not in ("origin", "ts", "event_id")])
    return joins.nearest(labels, right, "origin", seconds, "event_id").withColumnsRenamed({"r_ts": "h_ts", "r_seq": "h_id"})


def _confusion(decision: Column, label: Column) -> list[Column]:
    return [F.count_if(decision & label).alias("tp"), F.count_if(decision & ~label).alias("fp"), F.count_if(~decision & label).alias("fn")]


def _scored(counts: DataFrame, *keys: str) -> DataFrame:
    p, r, f = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(*keys, "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))


def first_labels(pairs: DataFrame) -> DataFrame:
    """One label a decision: the first."""
    w = W.partitionBy("h_id").orderBy("ts", "event_id")
    return pairs.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")


def accuracy_by_version(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """Counts and scores of each version, of all together ('micro'), and the versions' mean scores ('macro')."""
    pairs = first_labels(matched(labels, decisions)).withColumn("version", F.coalesce("own_version", "version", F.lit("unknown")))
    each = pairs.groupBy("version").agg(*_confusion(F.col("decision"), F.col("label")))
    micro = each.agg(F.lit("micro").alias("version"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    scored = _scored(each.unionByName(micro), "version")
    macro = scored.where("version <> 'micro'").agg(F.lit("macro").alias("version"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")])
    return scored.unionByName(macro)


def hourly_accuracy(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """Origin and hour join, the last row of each side; counts per origin and over all."""
    at = F.struct("ts", "event_id")
    hour = F.date_trunc("hour", "ts").alias("hour")
    a = labels.groupBy("origin", hour).agg(F.max_by("label", at).alias("label"))
    b = decisions.groupBy("origin", hour).agg(F.max_by("decision", at).alias("decision"))
    each = a.join(b, ["origin", "hour"]).groupBy("origin").agg(*_confusion(F.col("decision"), F.col("label")))
    return _scored(each.unionByName(each.agg(F.lit("all").alias("origin"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])), "origin")


def reliability(pairs: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """All bins of each key with n, mean score and share of true labels; empty ones are null."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    have = pairs.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("conf"), F.avg(F.col("label").cast("int")).alias("acc"))
    every = pairs.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return every.join(have, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("conf", 6).alias("conf"), F.round("acc", 6).alias("acc"))


def calibration(pairs: DataFrame, keys: list[str], bins: int = 10, least: int = 30, most: float = 0.06) -> DataFrame:
    """n, expected calibration error, Brier score and flags of each key."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    y = F.col("label").cast("int")
    each = pairs.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum(y).alias("y"), F.sum((F.col("score") - y) ** 2).alias("b"))
    out = each.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.abs(F.col("y") - F.col("s"))) / F.sum("n")).alias("ece"), (F.sum("b") / F.sum("n")).alias("brier"))
    return out.select(*keys, "n", F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"), (F.col("n") < least).alias("low_n"), (F.round("ece", 6) > most).alias("high_ece"))


def trend_bucket(ts: Column, minutes: int) -> Column:
    """Buckets of so many minutes from midnight."""
    day = F.date_trunc("day", ts)
    into = F.floor((F.unix_seconds(ts) - F.unix_seconds(day)) / (60 * minutes))
    return F.timestamp_seconds(F.unix_seconds(day) + into * 60 * minutes)


def origin_quality(pairs: DataFrame, strong: float, mixed: float) -> DataFrame:
    """Label precision of each origin and its class."""
    n = pairs.groupBy("origin").agg(F.count_if("label").alias("true_n"), F.count_if(~F.col("label")).alias("false_n"))
    p = safe_ratio(F.col("true_n"), F.col("true_n") + F.col("false_n"))
    return n.select("origin", "true_n", "false_n", F.round(p, 4).alias("precision"), banded(p, [(strong, "Strong"), (mixed, "Mixed")], "Weak").alias("quality"))


def quality_batches(pairs: DataFrame, start: str, hours: int) -> DataFrame:
    """Batches counted from the window's start by the decision's time."""
    i = F.floor((F.unix_seconds("h_ts") - F.unix_seconds(F.lit(start).cast("timestamp"))) / (3600 * hours))
    n = pairs.where(F.col("h_ts") >= F.lit(start).cast("timestamp")).groupBy(i.alias("batch")).agg(F.count_if("label").alias("tp"), F.count_if(~F.col("label")).alias("fp"))
    p = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return n.select("batch", "tp", "fp", F.round(p, 4).alias("precision"), banded(p, [(0.75, "Strong"), (0.40, "Mixed")], "Weak").alias("quality"))


def suppression(candidates: DataFrame, decisions: DataFrame, seconds: int = 300, least: int = 3) -> DataFrame:
    """Candidates, decisions with a candidate near, and the share of candidates suppressed, per origin."""
    near = joins.within(decisions.select("origin", "ts", "event_id"), candidates.select("origin", F.col("ts").alias("r_ts")), "origin", seconds)
    t = near.select("origin", "event_id").distinct().groupBy("origin").agg(F.count("*").alias("triggers"))
    c = candidates.groupBy("origin").agg(F.count("*").alias("candidates")).join(t, "origin", "left").fillna(0, ["triggers"])
    rate = safe_ratio(F.greatest(F.col("candidates") - F.col("triggers"), F.lit(0)), F.col("candidates"))
    level = F.when(F.col("candidates") < least, "Insufficient").otherwise(banded(rate, [(0.8, "High"), (0.5, "Medium")], "Low"))
    return c.select("origin", "candidates", "triggers", F.round(rate, 4).alias("rate"), level.alias("level"))


def coverage_trend(candidates: DataFrame, decisions: DataFrame, hours: int = 3) -> DataFrame:
    """Per origin and clock bucket: candidates, triggers, coverage and suppression."""
    bucket = trend_bucket(F.col("ts"), 60 * hours).alias("bucket")
    both = candidates.select("origin", bucket, F.lit(1).alias("c")).unionAll(decisions.select("origin", bucket, F.lit(0)))
    n = both.groupBy("origin", "bucket").agg(F.sum("c").alias("candidates"), F.sum(1 - F.col("c")).alias("triggers"))
    c = F.greatest("candidates", F.lit(1))
    return n.select("origin", "bucket", "candidates", "triggers", F.round(F.col("triggers") / c, 4).alias("coverage"), F.round(F.greatest(F.col("candidates") - F.col("triggers"), F.lit(0)) / c, 4).alias("suppressed"))


def score_distribution(scored: DataFrame, keys: list[str]) -> DataFrame:
    n = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))
    cuts = quantiles.exact(scored, keys, "score", {"median": 0.5, "p90": 0.9})
    return quantiles.joined(n, cuts, keys).select(*keys, "n", "mean", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"))


def score_bins(scored: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    return scored.groupBy(*keys, F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def threshold_quality(pairs: DataFrame, thresholds: DataFrame | None = None, default: float = 0.5) -> DataFrame:
    """Scores of each origin at its threshold."""
    t = pairs.withColumn("threshold", F.lit(default)) if thresholds is None else pairs.join(thresholds, "origin", "left").fillna(default, ["threshold"])
    return _scored(t.groupBy("origin", "threshold").agg(*_confusion(F.col("score") >= F.col("threshold"), F.col("label"))), "origin", "threshold")


def threshold_sweep(pairs: DataFrame, precision: float = 0.75, current: float = 0.5, step: float = 0.10) -> DataFrame:
    """The best of each origin's own scores as cutoff, from cumulative sums over falling scores; moved by step at most.

    Cutoffs that reach the precision are ordered by recall, F1, then the lower one; without any, by F1 first.
    """
    w = W.partitionBy("origin").orderBy(F.desc("cut")).rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy("origin")
    cuts = pairs.groupBy("origin", F.col("score").alias("cut")).agg(F.count_if("label").alias("t"), F.count_if(~F.col("label")).alias("f"))
    cuts = cuts.withColumn("tp", F.sum("t").over(w)).withColumn("fp", F.sum("f").over(w)).withColumn("fn", F.sum("t").over(all_) - F.col("tp"))
    p, r, f = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    cuts = cuts.withColumn("p", F.round(p, 9)).withColumn("r", F.round(r, 9)).withColumn("f", F.round(f, 9)).withColumn("ok", F.col("p") >= precision)
    order = F.when(F.col("ok"), F.struct(F.col("r").alias("a"), F.col("f").alias("b"), F.lit(0.0).alias("c"))).otherwise(F.struct(F.col("f").alias("a"), F.col("r").alias("b"), F.col("p").alias("c")))
    best = cuts.withColumn("i", F.row_number().over(W.partitionBy("origin").orderBy(F.desc("ok"), F.desc(order), "cut"))).where("i = 1")
    moved = F.least(F.greatest(F.col("cut"), F.lit(current - step)), F.lit(current + step))
    return best.select("origin", F.round("cut", 6).alias("best"), F.round(moved, 6).alias("recommended"), F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round("f", 6).alias("f1"), "ok")


def precision_threshold(pairs: DataFrame, precision: float) -> DataFrame:
    """The smallest cutoff of each origin whose precision reaches the target."""
    w = W.partitionBy("origin").orderBy(F.desc("cut")).rowsBetween(W.unboundedPreceding, 0)
    cuts = pairs.groupBy("origin", F.col("score").alias("cut")).agg(F.count_if("label").alias("t"), F.count("*").alias("n"))
    cuts = cuts.withColumn("p", F.sum("t").over(w) / F.sum("n").over(w))
    return cuts.groupBy("origin").agg(F.round(F.min(F.when(F.col("p") >= precision, F.col("cut"))), 6).alias("threshold"))


def what_if(pairs: DataFrame, current: float, other: float) -> DataFrame:
    """Scores at two thresholds in one pass, and their differences."""
    cols = []
    for name, t in (("cur", current), ("rec", other)):
        tp, fp, fn = (c for c in _confusion(F.col("score") >= t, F.col("label")))
        cols += [tp.alias(f"{name}_tp"), fp.alias(f"{name}_fp"), fn.alias(f"{name}_fn")]
    n = pairs.groupBy("origin").agg(F.count("*").alias("labels"), *cols)
    scores = {x: f1(F.col(f"{x}_tp"), F.col(f"{x}_fp"), F.col(f"{x}_fn")) for x in ("cur", "rec")}
    deltas = [F.round(scores["rec"][i] - scores["cur"][i], 4).alias(f"d_{m}") for i, m in enumerate(("precision", "recall", "f1"))]
    return n.select("origin", "labels", *deltas)


def dynamic_threshold(scored: DataFrame, now: str, hours: int, q: float, least: int) -> DataFrame:
    """Linear quantile of each origin's last hours, null below least rows."""
    last = scored.where(F.col("ts") >= F.expr(f"timestamp '{now}' - interval {hours} hour"))
    n = quantiles.joined(last.groupBy("origin").agg(F.count("*").alias("n")), quantiles.exact(last, ["origin"], "score", {"cut": q}), ["origin"])
    return n.select("origin", "n", F.round(F.when(F.col("n") >= least, F.col("cut")), 6).alias("threshold"))


def greedy_by_trigger(labels: DataFrame, decisions: DataFrame, seconds: int = 300) -> DataFrame:
    """One-to-one: decisions in time order each take the nearest label not yet taken. A chain of rows without a gap meets in a task."""
    return _greedy(labels, decisions, seconds, False)


def greedy_by_label(labels: DataFrame, decisions: DataFrame, seconds: int = 300) -> DataFrame:
    """One-to-one: labels in order each take the nearer of the two decisions beside them, if still free."""
    return _greedy(labels, decisions, seconds, True)


def _grouped(df: DataFrame, seconds: int, rows: int = GROUP_ROWS):
    """df grouped by origin and whole chains of about so many rows together.

    A chain's rows have no gap wider than the window, so chains can be matched apart from each other. Two rows of one
    bucket as wide as the window are never further apart; gaps lie between buckets and show in their first and last times.
    """
    width = seconds * 1_000_000
    x = df.withColumn("__b", F.floor(F.col("t") / width))
    line = W.partitionBy("o").orderBy("b")  # a row an origin and bucket
    buckets = x.groupBy(F.col("origin").alias("o"), F.col("__b").alias("b")).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))
    begins = F.coalesce(F.col("first") - F.lag("last").over(line) > width, F.lit(True))
    # rows before a chain's first bucket tell which group it is in
    before = F.coalesce(F.sum("n").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("at", F.when(begins, before)).withColumn("at", F.last("at", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, 0)))
    of = buckets.select("o", "b", F.floor(F.col("at") / rows).alias("__group"))
    return x.join(of, F.col("origin").eqNullSafe(F.col("o")) & F.col("__b").eqNullSafe(F.col("b"))).select(*df.columns, "__group").groupBy("origin", "__group")


class _Free:
    """Places 0 .. n - 1, of which some get taken: the next free one on either side, by paths that are shortened as they are walked."""

    def __init__(self, n: int):
        self.n, self.up, self.down = n, list(range(n + 1)), list(range(n + 1))

    @staticmethod
    def _root(of: list[int], i: int) -> int:
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    def at_least(self, i: int) -> int | None:
        j = self._root(self.up, i)
        return j if j < self.n else None

    def below(self, i: int) -> int | None:
        j = self._root(self.down, i)  # place j - 1 stands at j; 0 is none
        return j - 1 if j else None

    def take(self, i: int) -> None:
        self.up[i], self.down[i + 1] = i + 1, i


def _greedy(labels: DataFrame, decisions: DataFrame, seconds: int, by_label: bool) -> DataFrame:
    both = labels.select("origin", F.unix_micros("ts").alias("t"), F.lit(0).alias("kind"), F.col("event_id").alias("id")).unionAll(
        decisions.select("origin", F.unix_micros("ts"), F.lit(1), "event_id")
    )
    width = seconds * 1_000_000

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "id"])
        l, d = rows[rows.kind == 0], rows[rows.kind == 1]
        lt, dt, lid, did = l.t.to_numpy(), d.t.to_numpy(), l.id.to_numpy(), d.id.to_numpy()
        out = []
        mine, others, ids, other_ids = (lt, dt, lid, did) if by_label else (dt, lt, did, lid)
        free = _Free(len(others))
        for t, i in zip(mine, ids, strict=True):
            at = int(np.searchsorted(others, t))
            near = [j for j in (free.below(at), free.at_least(at)) if j is not None]
            if by_label:
                near = [j for j in near if j in (at - 1, at)]
            near = [j for j in near if abs(int(others[j]) - int(t)) <= width]
            if near:
                j = min(near, key=lambda j: (abs(int(others[j]) - int(t)), j))
                free.take(j)
                out.append((rows.origin.iloc[0], *((i, other_ids[j]) if by_label else (other_ids[j], i))))
        return pd.DataFrame(out, columns=["origin", "label_id", "decision_id"])

    return _grouped(both, seconds).applyInPandas(match, "origin string, label_id long, decision_id long")


def two_pointer_matches(candidates: DataFrame, decisions: DataFrame, seconds: int = 300) -> DataFrame:
    """One-to-one matches of two sorted streams, counted per origin, with coverage and its class."""
    both = candidates.select("origin", F.unix_micros("ts").alias("t"), F.lit(0).alias("kind"), F.col("event_id").alias("id")).unionAll(decisions.select("origin", F.unix_micros("ts"), F.lit(1), "event_id"))
    width = seconds * 1_000_000

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        c, d = (np.sort(rows.t[rows.kind == k].to_numpy()) for k in (0, 1))
        i = j = n = 0
        while i < len(c) and j < len(d):
            if abs(int(c[i]) - int(d[j])) <= width:
                n, i, j = n + 1, i + 1, j + 1
            elif c[i] < d[j]:
                i += 1
            else:
                j += 1
        return pd.DataFrame([(rows.origin.iloc[0], len(c), n)], columns=["origin", "candidates", "matched"])

    parts = _grouped(both, seconds).applyInPandas(match, "origin string, candidates long, matched long")
    n = parts.groupBy("origin").agg(F.sum("candidates").alias("candidates"), F.sum("matched").alias("matched"))
    rate = safe_ratio(F.col("matched"), F.col("candidates"))
    return n.select("origin", "candidates", "matched", F.round(rate, 4).alias("coverage"), banded(rate, [(0.15, "High"), (0.05, "Medium")], "Low").alias("level"))
