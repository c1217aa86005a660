"""Hourly price frames: features, labels, regimes, folds, and simulations of trading on predictions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import safe_ratio
from . import gates, ranges


def _by_time():
    return W.partitionBy("symbol").orderBy("ts")


def _rows(n: int):
    return _by_time().rowsBetween(-(n - 1), 0)


def _full(value: Column, n: int, least: int) -> Column:
    return F.when(F.count(F.lit(1)).over(_rows(n)) >= least, value)


def returns(bars: DataFrame, *steps: int) -> DataFrame:
    """ret_k for each k: relative change over k bars, 0 where there is none."""
    return bars.withColumns({f"ret_{k}": F.coalesce(F.try_divide(F.col("close") - F.lag("close", k).over(_by_time()), F.lag("close", k).over(_by_time())), F.lit(0.0)) for k in steps})


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range of n bars, the first full one filled back."""
    before = F.coalesce(F.lag("close").over(_by_time()), F.col("close"))
    ranged = bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    full = ranged.withColumn("atr", _full(F.avg("tr").over(_rows(n)), n, n))
    first = F.first("atr", ignorenulls=True).over(_by_time().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return full.withColumn("atr", F.coalesce("atr", first)).drop("tr")


def sma_gap(bars: DataFrame, n: int = 24, least: int = 12) -> DataFrame:
    sma = F.nullif(_full(F.avg("close").over(_rows(n)), n, least), F.lit(0.0))
    return bars.withColumn("sma_gap", F.coalesce((F.col("close") - sma) / sma, F.lit(0.0)))


def rolling_vol(bars: DataFrame, n: int = 6) -> DataFrame:
    """Sample deviation of one-bar returns over n bars, with a third of them at least."""
    return bars.withColumn("vol", F.coalesce(_full(F.stddev_samp("ret_1").over(_rows(n)), n, max(3, n // 3)), F.lit(0.0)))


def zscored(bars: DataFrame, column: str, name: str) -> DataFrame:
    w = W.partitionBy("symbol")
    return bars.withColumn(name, F.coalesce(F.try_divide(F.col(column) - F.avg(column).over(w), F.stddev_samp(column).over(w)), F.lit(0.0)))


def high_vol(bars: DataFrame, q: float = 0.9) -> DataFrame:
    """Flag of volatility at or above the series' quantile; the quantile is joined back, one row a symbol."""
    cuts = bars.groupBy("symbol").agg(F.percentile("vol", q).alias("cut"))
    return bars.join(cuts, "symbol").withColumn("high_vol", (F.col("vol") >= F.col("cut")).cast("int")).drop("cut")


def price_burst(bars: DataFrame) -> DataFrame:
    gap = bars.withColumn("gap", F.avg("close").over(_rows(6)) - F.avg("close").over(_rows(48)))
    return zscored(gap, "gap", "gap_z").withColumn("price_burst", (F.col("gap_z") > 2).cast("int")).drop("gap", "gap_z")


def features(bars: DataFrame) -> DataFrame:
    return price_burst(high_vol(rolling_vol(sma_gap(atr(returns(bars, 1, 3, 6))))))


def social_rate(bars: DataFrame) -> DataFrame:
    """Smoothed hourly volume, its z-score as a sigmoid, and a burst flag."""
    s = bars.withColumn("rate", F.avg("volume").over(_rows(6))).withColumn("short", F.avg("volume").over(_rows(3)))
    s = zscored(zscored(s, "rate", "z6"), "short", "z3")
    return s.select("symbol", "ts", F.round(1 / (1 + F.exp(-F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.col("z6"))))), 6).alias("score"), (F.col("z3") > 2).cast("int").alias("burst"))


def market_regime(bars: DataFrame) -> DataFrame:
    calm = F.try_divide(F.stddev_samp("close").over(_rows(14)), F.avg("close").over(_rows(14))) < 0.06
    moved = F.abs(F.try_divide(F.col("close") - F.lag("close", 30).over(_by_time()), F.lag("close", 30).over(_by_time()))) > 0.08
    return bars.withColumn("regime", F.when(F.coalesce(calm & moved, F.lit(False)), "trending").otherwise("choppy"))


def regime_stats(bars: DataFrame) -> DataFrame:
    n = bars.groupBy("regime").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 2))


def labelled(bars: DataFrame, horizon: int) -> DataFrame:
    """label: whether the close `horizon` bars on is higher; bars without one are left out."""
    ahead = F.lead("close", horizon).over(_by_time())
    return bars.withColumn("ahead", ahead).where("ahead is not null").withColumn("label", (F.col("ahead") > F.col("close")).cast("int"))


def provenance(bars: DataFrame) -> DataFrame:
    step = bars.withColumn("step", F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(_by_time())))
    return step.groupBy("symbol").agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), (F.coalesce(F.min("step"), F.lit(0)) >= 0).alias("monotonic"),
        F.min("close").alias("low"), F.max("close").alias("high"), F.round(F.var_pop("close"), 6).alias("var"),
    )


def market_context(bars: DataFrame, hours: int) -> DataFrame:
    """Each symbol's change over its last hours."""
    w = W.partitionBy("symbol").orderBy(F.desc("ts"))
    r = F.try_divide(F.col("close") - F.lead("close", hours).over(w), F.lead("close", hours).over(w))
    return bars.withColumn("change", F.round(r, 6)).withColumn("i", F.row_number().over(w)).where("i = 1").select("symbol", "ts", "close", "change")


def folds(bars: DataFrame, train: int, test: int, n_splits: int) -> DataFrame:
    """(fold, symbol, ts, part): windows of train and test bars, a stride of test / n_splits apart (or the whole test)."""
    stride = max(1, test // n_splits)
    numbered = bars.withColumn("i", F.row_number().over(_by_time()) - 1)
    last = numbered.withColumn("top", F.max("i").over(W.partitionBy("symbol")))
    fold = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold")
    at = last.select("symbol", "ts", "i", "top", fold).withColumn("rel", F.col("i") - F.col("fold") * stride)
    at = at.where((F.col("rel") >= 0) & (F.col("rel") < train + test) & (F.col("fold") * stride + train + test <= F.col("top") + 1))
    return at.select("fold", "symbol", "ts", F.when(F.col("rel") < train, "train").otherwise("test").alias("part"))


def fold_metrics(scored: DataFrame, confidence: float) -> DataFrame:
    """scored: fold, p (of a rise), ret (forward). Trades where max(p, 1 - p) reaches the confidence, signed by the side."""
    t = scored.where(F.greatest("p", 1 - F.col("p")) >= confidence).withColumn("r", F.when(F.col("p") >= 0.5, F.col("ret")).otherwise(-F.col("ret")))
    gain, loss = F.sum(F.greatest("r", F.lit(0.0))), F.sum(F.greatest(-F.col("r"), F.lit(0.0)))
    return t.groupBy("fold").agg(F.count("*").alias("trades"), F.round(F.avg((F.col("r") > 0).cast("int")), 6).alias("win_rate"), F.round(F.try_divide(gain, loss), 6).alias("profit_factor"))


def pairwise_backtest(signals: DataFrame) -> DataFrame:
    """Each signal closed by the symbol's next one; n, mean return and Sharpe by symbol and over all."""
    side = F.when(F.col("direction") == "long", 1).otherwise(-1)
    closed = ranges.with_next(signals, "symbol", "ts", ["event_id"], "price", "__close")
    r = closed.withColumn("ret", side * (F.col("__close") / F.col("price") - 1)).drop("__close").where("ret is not null")
    cols = [F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean"), F.round(F.try_divide(F.avg("ret"), F.stddev_samp("ret")), 6).alias("sharpe"), F.round(F.avg((F.col("ret") > 0).cast("int")), 6).alias("win_rate")]
    return r.groupBy("symbol").agg(*cols).unionByName(r.agg(F.lit("total").alias("symbol"), *cols))


def drawdown(points: DataFrame, key: str, order: list[str], equity: str) -> DataFrame:
    """The deepest fall of equity from its highest point so far, as a share."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return points.withColumn("top", F.max(equity).over(w)).groupBy(key).agg(F.round(F.min(F.try_divide(F.col(equity) - F.col("top"), F.col("top"))), 6).alias("max_drawdown"))


def performance(trades: DataFrame, key: str) -> DataFrame:
    """Sharpe, Sortino, win rate and profit factor of pnl_pct per key; figures beyond 5 are null."""
    pnl, losses = F.col("pnl_pct"), F.when(F.col("pnl_pct") < 0, F.col("pnl_pct"))
    sharpe = F.when(F.count("*") > 2, F.try_divide(F.avg(pnl), F.stddev_pop(pnl)))
    sortino = F.when(F.count(losses) >= 2, F.try_divide(F.avg(pnl), F.stddev_pop(losses)))
    pf = F.try_divide(F.sum(F.greatest(pnl, F.lit(0.0))), F.sum(F.greatest(-pnl, F.lit(0.0))))
    bounded = lambda c: F.round(F.when(F.abs(c) <= 5, c), 6)
    return trades.groupBy(key).agg(F.count("*").alias("n"), bounded(sharpe).alias("sharpe"), bounded(sortino).alias("sortino"), F.round(F.avg((pnl >= 0).cast("int")), 6).alias("win_rate"), bounded(pf).alias("profit_factor"))


def walkforward_audit(signals: DataFrame, now: str, days: int, k: int) -> DataFrame:
    """n, mean and Sharpe of ret in k equal folds of the trailing window; a row on a border is in both."""
    span = days * 86400 / k
    fold = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")
    age = F.unix_micros("ts") / 1e6 - (F.unix_seconds(F.lit(now).cast("timestamp")) - days * 86400)
    at = signals.select("symbol", "ret", age.alias("age"), fold).where((F.col("age") >= F.col("fold") * span) & (F.col("age") <= (F.col("fold") + 1) * span))
    return at.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean"), F.round(F.when(F.count("*") > 2, F.try_divide(F.avg("ret"), F.stddev_pop("ret"))), 6).alias("sharpe"))


def qualified(shadow: DataFrame, symbols: list[str], start: str, end: str, conf_min: float, deadband: float) -> DataFrame:
    c = F.col("conf")
    return shadow.where(F.col("symbol").isin(symbols) & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) & F.col("direction").isNotNull() & (c >= F.coalesce("own_min", F.lit(conf_min))) & (F.abs(c - 0.5) >= deadband))


def min_flip(signals: DataFrame, minutes: int) -> DataFrame:
    """Per symbol, drops a signal against the last kept one within so many minutes."""
    return gates.kept(signals.select("symbol", "ts", "event_id", "direction"), gates.min_flip(minutes), ["event_id", "direction"])


def cooldown(alerts: DataFrame, minutes: int = 30, least_move: float = 7.0, least_volume: float = 10.0, differ: float = 2.0) -> DataFrame:
    """Alerts that are large enough, without those soon after the last accepted one of the asset and close to it in size."""
    large = alerts.where((F.abs("move") >= least_move) & (F.col("volume") >= least_volume)).select("symbol", "ts", "event_id", "move")
    return gates.kept(large, gates.cooldown(minutes, differ), ["event_id"])


def _trade(p: np.ndarray, close: np.ndarray, confidence: float, debounce: int, horizon: int, cost: float) -> np.ndarray:
    """Returns of a long-only run: enter the bar after p reaches the confidence, leave after the horizon or at the last bar; the debounce starts anew there."""
    n, leave, out = len(p), -(10**9), []
    sure = np.flatnonzero(p[: max(n - 1, 0)] >= confidence)
    while (k := int(np.searchsorted(sure, leave + debounce))) < len(sure):
        enter = int(sure[k]) + 1
        leave = min(enter + horizon, n - 1)
        out.append(close[leave] / close[enter] - 1 - cost)
    return np.array(out)


def backtest(predictions: DataFrame, confidence: float, debounce: int, horizon: int, fees_bps: float = 1.0, slip_bps: float = 2.0) -> DataFrame:
    """symbol, trades, win_rate, profit_factor, max_drawdown, final equity of a stateful long-only run per symbol."""
    return grid_search(predictions, [(confidence, debounce, horizon)], fees_bps, slip_bps).drop("conf", "debounce", "horizon")


def grid_search(predictions: DataFrame, grid: list[tuple[float, int, int]], fees_bps: float = 1.0, slip_bps: float = 2.0) -> DataFrame:
    """The backtest of each symbol at each (confidence, debounce of at least 1, horizon), all points over one sorted copy of its bars.

    A trade depends on the one before, so a symbol's hourly bars (8,760 a year) meet in one task; rows are never copied.
    """
    cost = 2 * (fees_bps + slip_bps) / 1e4
    columns = ["symbol", "conf", "debounce", "horizon", "trades", "win_rate", "profit_factor", "max_drawdown", "equity"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        p, close, out = rows.p.to_numpy(), rows.close.to_numpy(), []
        for conf, debounce, horizon in grid:
            r = _trade(p, close, conf, max(debounce, 1), horizon, cost)
            equity, gain, loss = np.cumprod(np.append(1.0, 1 + r)), float(r[r > 0].sum()), float(-r[r < 0].sum())
            deepest = float((equity / np.maximum.accumulate(equity) - 1).min())
            out.append((rows.symbol.iloc[0], float(conf), int(debounce), int(horizon), len(r), float((r > 0).mean()) if len(r) else 0.0, gain / loss if loss else gain, deepest, float(equity[-1])))
        return pd.DataFrame(out, columns=columns)

    schema = "symbol string, conf double, debounce int, horizon int, trades long, win_rate double, profit_factor double, max_drawdown double, equity double"
    return predictions.select("symbol", "ts", "close", "p").groupBy("symbol").applyInPandas(run, schema)


def tuned(results: DataFrame, least_trades: int) -> DataFrame:
    """Grid points by feasibility, trade-weighted profit factor and drawdown."""
    w = lambda c: F.round(safe_ratio(F.sum(F.col(c) * F.col("trades")), F.sum("trades")), 6).alias(c)
    agg = results.groupBy("conf", "debounce", "horizon").agg(F.sum("trades").alias("trades"), w("win_rate"), w("profit_factor"), F.round(F.min("max_drawdown"), 6).alias("max_drawdown"))
    order = W.orderBy(F.desc(F.col("trades") >= least_trades), F.desc("profit_factor"), "max_drawdown", "conf", "debounce", "horizon")
    return agg.withColumn("place", F.row_number().over(order))


def ema(bars: DataFrame, column: str, span: int) -> DataFrame:
    """symbol, ts and the exponential mean without adjustment of a column, from its first value on."""
    return ranges.decayed(bars, "symbol", "ts", column, 2 / (span + 1), "ema").withColumn("ema", F.round("ema", 6))


def trailing_examples(dense: DataFrame, triggers: DataFrame) -> DataFrame:
    """Per origin and bucket: trailing sums, expanding z before the bucket, trailing deviation, and whether one of the next 6 buckets has a trigger."""
    w = W.partitionBy("origin").orderBy("bucket")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    t = triggers.groupBy("origin", F.date_trunc("hour", "ts").alias("bucket")).agg(F.count("*").alias("t"))
    x = dense.join(t, ["origin", "bucket"], "left").fillna(0, ["t"])
    x = x.withColumns({f"n_{k}h": F.sum("n").over(w.rowsBetween(-(k - 1), 0)) for k in (1, 6, 24, 72)})
    x = x.withColumn("z", F.round(F.coalesce(F.try_divide(F.col("n") - F.avg("n").over(before), F.stddev_pop("n").over(before)), F.lit(0.0)), 6))
    x = x.withColumn("vol", F.round(F.coalesce(F.stddev_pop("n").over(w.rowsBetween(-72, -1)), F.lit(0.0)), 6))
    x = x.withColumn("label", (F.coalesce(F.max("t").over(w.rowsBetween(1, 6)), F.lit(0)) > 0).cast("int"))
    i, n = F.row_number().over(w), F.count("*").over(W.partitionBy("origin"))
    return x.withColumn("i", i).withColumn("m", n).where("i > 6 and i <= m - 6").drop("i", "m", "t", "n")
