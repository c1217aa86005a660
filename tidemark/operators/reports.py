"""Relational parts of reports: market enrichment, cross-origin correlation, relative buckets, packs, tails, paper trades."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import first_truthy
from ..functions.stats import pearson, safe_ratio
from . import joins


def volatility_labels(bars: DataFrame, window: int = 6, q: float = 0.75) -> DataFrame:
    """symbol, ts, vol, label: sample deviation of hourly returns against the floor-rank cut of the positive ones."""
    w = W.partitionBy("symbol").orderBy("ts")
    r = bars.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    v = r.withColumn("vol", F.round(F.stddev_samp("ret").over(w.rowsBetween(-(window - 1), 0)), 9))
    placed = v.where("vol > 0").withColumn("i", F.row_number().over(W.partitionBy("symbol").orderBy("vol"))).withColumn("n", F.count("*").over(W.partitionBy("symbol")))
    cuts = placed.where(F.col("i") == F.floor(F.lit(q) * (F.col("n") - 1)) + 1).select("symbol", F.col("vol").alias("cut"))
    label = F.when(F.col("vol").isNull() | F.col("cut").isNull(), "n/a").when(F.col("vol") >= F.col("cut"), "high").otherwise("low")
    return v.join(cuts, "symbol", "left").select("symbol", "ts", "vol", label.alias("label"))


def enriched_trend(trend: DataFrame, labels: DataFrame, bursts: DataFrame) -> DataFrame:
    """Trend points with the market's label of their hour, and alerts: high error, and a burst at the same time if so."""
    b = bursts.select(F.col("bucket"), F.lit(True).alias("burst")).distinct()
    j = trend.join(labels.select(F.col("ts").alias("bucket"), F.col("label").alias("volatility_regime")), "bucket", "left").join(b, "bucket", "left")
    alerts = F.array_compact(F.array(F.when(F.col("high_ece"), "high_ece"), F.when(F.col("high_ece") & F.col("burst"), "social_burst_overlap")))
    return j.select(*trend.columns, F.coalesce("volatility_regime", F.lit("n/a")).alias("volatility_regime"), F.array_join(alerts, ",").alias("alerts"))


def interpolated(points: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Nulls of value between two known ones filled on a straight line; none at the ends."""
    w, back = (W.partitionBy(key).orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (F.asc(ts), F.desc(ts)))
    t = F.unix_seconds(F.col(ts))
    known = F.when(F.col(value).isNotNull(), F.struct(t.alias("t"), F.col(value).alias("v")))
    a, b = F.last(known, ignorenulls=True).over(w), F.last(known, ignorenulls=True).over(back)
    line = a["v"] + (b["v"] - a["v"]) * F.try_divide(t - a["t"], b["t"] - a["t"])
    return points.withColumn(value, F.coalesce(F.col(value), line))


def signed_lead_lag(a: DataFrame, b: DataFrame, lags: int) -> DataFrame:
    """lag with the largest signed correlation of a(t) and b(t + lag) of two series (bucket, x) and (bucket, y)."""
    shifted = a.withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).withColumn("bucket", F.timestamp_seconds(F.unix_seconds("bucket") + F.col("lag") * 3600))
    r = shifted.join(b, "bucket").groupBy("lag").agg(F.round(pearson(F.col("x").cast("double"), F.col("y").cast("double")), 6).alias("r"))
    return r.agg(F.max(F.struct("r", (-F.col("lag")).alias("m"))).alias("best")).select((-F.col("best.m")).alias("lag"), "best.r")


def lag_correlations(x: np.ndarray, y: np.ndarray, lags: int) -> np.ndarray:
    """Correlations of x(t) and y(t + lag) over their overlap for lags -lags .. lags; 0 with fewer than three points or a constant side.

    Sums of products come from one Fourier transform, sums and squares from prefix sums.
    """
    n, size = len(x), 1 << (2 * len(x)).bit_length()
    product = np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size)
    if (x == np.rint(x)).all() and (y == np.rint(y)).all():
        product = np.rint(product)
    lag = np.arange(-lags, lags + 1)
    m = np.maximum(n - np.abs(lag), 0)
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (x, x * x, y, y * y)]
    a, b = np.minimum(np.maximum(-lag, 0), n), np.minimum(np.maximum(lag, 0), n)
    (sx, qx), (sy, qy) = ([s[o + m] - s[o] for s in pair] for o, pair in ((a, sums[:2]), (b, sums[2:])))
    vx, vy = m * qx - sx * sx, m * qy - sy * sy
    ok = (m > 2) & (vx > 1e-12 * m * qx) & (vy > 1e-12 * m * qy)
    return np.where(ok, (m * product[lag % size] - sx * sy) / np.sqrt(np.where(ok, vx * vy, 1.0)), 0.0)


def permutation_test(series: DataFrame, lags: int, times: int, seed: int = 4242, each: int = 16) -> DataFrame:
    """a, b, lag, r, p: best |r| of each pair of series over lags, and the share of shuffled ones whose best is no less.

    series: a, b, x and y as arrays over the same buckets. A shuffle is named by its number and spread over tasks `each`
    at a time, so a pair's test is as many tasks as it has parts, and the result does not depend on them.
    """

    def test(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.itertuples():
                x, y = np.array(row.x, float), np.array(row.y, float)
                r = lag_correlations(x, y, lags)
                at = int(np.abs(np.round(r, 12)).argmax())
                top = abs(r[at]) - 1e-12
                hits = sum(np.abs(lag_correlations(x, np.random.default_rng([seed, i]).permutation(y), lags)).max() >= top for i in range(row.part, min(row.part + each, times)))
                out.append((row.a, row.b, at - lags if top > 0 else 0, float(r[at]), int(hits)))
            yield pd.DataFrame(out, columns=["a", "b", "lag", "r", "hits"])

    parts = series.select("a", "b", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(times - 1), F.lit(each))).alias("part"))
    found = parts.repartition("a", "b", "part").mapInPandas(test, "a string, b string, lag int, r double, hits long")
    return found.groupBy("a", "b").agg(F.first("lag").alias("lag"), F.first("r").alias("r"), ((F.sum("hits") + 1) / (times + 1)).alias("p"))


def relative_hours(events: DataFrame, now: str, n: int) -> DataFrame:
    """Counts by whole hours before now, 0 to n - 1."""
    i = F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("ts")) / 3600)
    return events.withColumn("hours_ago", i).where((F.col("hours_ago") >= 0) & (F.col("hours_ago") < n)).groupBy("origin", "hours_ago").agg(F.count("*").alias("n"))


def feature_pack(counts: DataFrame) -> DataFrame:
    """Sums of each origin's last 1, 6, 24 and 72 observed buckets."""
    w = W.partitionBy("origin").orderBy(F.desc("bucket"))
    last = counts.withColumn("i", F.row_number().over(w)).where("i <= 72")
    return last.groupBy("origin").agg(*[F.sum(F.when(F.col("i") <= k, F.col("n")).otherwise(0)).alias(f"n_{k}h") for k in (1, 6, 24, 72)])


def trend_labels(points: DataFrame, key: str, order: str, value: str, least: float) -> DataFrame:
    """Slope of each key's value over its points in order, as improving, declining or stable."""
    w = W.partitionBy(key).orderBy(order)
    x, n = F.col("i").cast("double"), F.count("*")
    slope = F.try_divide(n * F.sum(x * F.col(value)) - F.sum(x) * F.sum(value), n * F.sum(x * x) - F.sum(x) * F.sum(x))
    s = points.withColumn("i", F.row_number().over(w) - 1).groupBy(key).agg(F.round(F.coalesce(slope, F.lit(0.0)), 6).alias("slope"))
    return s.withColumn("trend", F.when(F.col("slope") >= least, "improving").when(F.col("slope") <= -least, "declining").otherwise("stable"))


def distinct_tail(rows: DataFrame, keys: list[str], last: int, n: int, *order: str) -> DataFrame:
    """Of the last rows, the latest of each key combination, the latest n of those."""
    desc = [F.desc(c) for c in order]
    tail = rows.orderBy(*desc).limit(last)
    return tail.withColumn("__i", F.row_number().over(W.partitionBy(*keys).orderBy(*desc))).where("__i = 1").drop("__i").orderBy(*desc).limit(n)


def drift_penalty(scored: DataFrame) -> DataFrame:
    """Score less a share that grows with drifted features, half of it at most."""
    return scored.withColumn("penalised", F.round(F.col("score") * (1 - F.least(F.lit(0.5), 0.05 * F.col("drifted"))), 6))


def version_quality(labels: DataFrame, matched: DataFrame) -> DataFrame:
    """Labels of each version, matched or not; recall is 1 wherever one is true, as misses are not known."""
    j = labels.select("event_id", "label").join(matched.select("event_id", "version"), "event_id", "left").withColumn("version", F.coalesce("version", F.lit("unknown")))
    n = j.groupBy("version").agg(F.count_if("label").alias("tp"), F.count_if(~F.col("label")).alias("fp"))
    return n.select("version", "tp", "fp", F.round(safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), 4).alias("precision"), F.when(F.col("tp") > 0, 1.0).otherwise(0.0).alias("recall"))


def normal_schema(raw: DataFrame, alternatives: dict[str, list[str]]) -> DataFrame:
    """Each column from the first of its alternatives that is there and neither null nor empty."""
    have = set(raw.columns)
    return raw.select(*[first_truthy(*[F.col(c) for c in names if c in have] or [F.lit(None)]).alias(name) for name, names in alternatives.items()])


def shadow_rows(history: DataFrame, label: Column, score: Column) -> DataFrame:
    """Direction by the score, confidence by the label's first letters."""
    low = F.lower(label)
    conf = F.when(low.startswith("high"), 0.75).when(low.startswith("med"), 0.5).otherwise(0.3)
    return history.withColumn("direction", F.when(score >= 0.5, "long").otherwise("short")).withColumn("confidence", conf)


def paper_trades(entries: DataFrame, prices: DataFrame, hours: int, cost: float, stop: float) -> DataFrame:
    """Entry and exit prices as of the times, a stop at the first of ten points between, and the net result of each trade with its time of entry."""
    points = F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i")
    asked = entries.select("symbol", "event_id", "side", points, F.col("ts").alias("entered"))
    asked = asked.withColumn("ts", F.timestamp_micros(F.unix_micros("entered") + F.col("i").cast("long") * (hours * 360_000_000)))
    at = joins.forward_asof(asked, prices, "symbol", "price")
    first = at.where("i = 0").select("event_id", F.col("price").alias("entry"))
    j = at.join(first, "event_id").withColumn("move", F.col("side") * (F.col("price") / F.col("entry") - 1))
    done = F.coalesce(F.min_by(F.when(F.col("move") <= -stop, F.col("move")), F.when(F.col("move") <= -stop, F.col("i"))), F.max_by("move", "i"))
    return j.groupBy("symbol", "event_id").agg(F.round(done - cost, 6).alias("pnl_pct"), F.count_if(F.col("move") <= -stop).cast("boolean").alias("stopped"), F.first("entered").alias("ts"))


def paper_equity(trades: DataFrame, order: list[str], times: DataFrame | None = None, rows: int = joins.RANGE_ROWS) -> DataFrame:
    """Compounded equity of each symbol's trades in order, which starts with a time: products of ranges of time, then within each.

    The ranges' borders are taken from times, if given: the same times, cheaper to read.
    A loss of all or more makes the factor 1 + pnl_pct zero or negative; the product keeps its zeros and signs.
    """
    f = 1 + F.col("pnl_pct")
    parts = {"__ln": F.coalesce(F.ln(F.abs(f)), F.lit(0.0)), "__neg": (f < 0).cast("long"), "__zero": (f == 0).cast("long")}
    x = joins.ranged(trades, order[0], joins.time_cuts(trades if times is None else times, order[0], rows)).withColumns(parts)
    before = W.partitionBy("__s").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    sums = x.groupBy(F.col("symbol").alias("__s"), F.col("__b").alias("__p")).agg(*[F.sum(c).alias(c) for c in parts])
    starts = sums.select("__s", "__p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in parts])
    own = W.partitionBy("symbol", "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumns({c: F.sum(c).over(own) for c in parts}).join(starts, F.col("symbol").eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__p")))
    ln, neg, zero = (F.coalesce(F.col(c), F.lit(0)) + F.col(f"{c}0") for c in parts)
    equity = F.when(zero > 0, 0.0).otherwise(F.exp(ln) * F.when(neg % 2 == 1, -1).otherwise(1))
    return x.withColumn("equity", F.round(equity, 6)).select(*trades.columns, "equity")


def notifications(actions: DataFrame, calibration: DataFrame, accuracy: DataFrame) -> DataFrame:
    """kind, subject, level of three sources: sure rollbacks, high calibration error, low F1."""
    a = actions.where("action = 'rollback'").select(F.lit("action").alias("kind"), F.col("version").alias("subject"), F.when(F.col("confidence") >= 0.8, "critical").otherwise("warning").alias("level"))
    c = calibration.where("high_ece").select(F.lit("calibration"), "origin", F.when(F.col("ece") > 0.15, "critical").otherwise("warning"))
    f = accuracy.where("f1 < 0.5").select(F.lit("accuracy"), "version", F.lit("info"))
    return a.unionAll(c).unionAll(f)
