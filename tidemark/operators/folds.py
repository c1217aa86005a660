"""Models judged on rows they have not seen: logistic models of all folds in one fit, isotonic calibration across folds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import shared
from . import market, quality

RIDGE, ROUNDS, CLOSE = 1e-3, 40, 1e-10
#: Different scores of a range that is pooled in one task, on average, and the most ranges.
RANGE_VALUES, RANGES = 1 << 14, 1024


def logistic(rows: DataFrame, fold: str, features: list[str], label: str = "label", ridge: float = RIDGE) -> DataFrame:
    """A row a fold: mean and scale of the features, weights (the intercept last) of its logistic model on rows, which each belong to the folds they train.

    All folds are fitted at once by Newton steps: a round is one aggregate of gradient and curvature sums keyed by fold,
    of which a short row a fold comes to the driver. Classes weigh the same, features are scaled by their deviation in
    the fold, and the ridge is on scaled weights without the intercept. A fold of one class has its intercept alone.
    """
    spark, d = rows.sparkSession, len(features)
    kind = rows.schema[fold].dataType.simpleString()
    with shared.scratch(spark):
        x = [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features]
        data = shared.written(rows.select(F.col(fold).alias("fold"), F.col(label).cast("double").alias("y"), F.array(*x).alias("x")).where("y is not null"), "fold-rows")
        first = data.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("k"), *[f(F.col("x")[j]).alias(f"{name}{j}") for j in range(d) for f, name in ((F.avg, "m"), (F.stddev_samp, "s"))]).collect()
        models = {}
        for r in first:
            scale = np.array([r[f"s{j}"] or 1.0 for j in range(d)])
            one = r["k"] in (0, r["n"])
            models[r["fold"]] = {"n": r["n"], "k": r["k"], "mean": np.array([r[f"m{j}"] for j in range(d)]), "scale": scale, "w": np.zeros(d + 1), "open": not one}
            if one:
                models[r["fold"]]["w"][d] = np.log((r["k"] + 0.5) / (r["n"] - r["k"] + 0.5))
        for _ in range(ROUNDS):
            if not any(m["open"] for m in models.values()):
                break
            now = spark.createDataFrame([(f, m["mean"].tolist(), m["scale"].tolist(), m["w"].tolist(), m["n"] / (2 * m["k"]), m["n"] / (2 * (m["n"] - m["k"]))) for f, m in models.items() if m["open"]], f"fold {kind}, mean array<double>, scale array<double>, w array<double>, one double, zero double")
            z = [(F.col("x")[j] - F.col("mean")[j]) / F.col("scale")[j] for j in range(d)] + [F.lit(1.0)]
            at = data.join(F.broadcast(now), "fold").select("fold", "y", F.array(*z).alias("z"), "w", F.when(F.col("y") > 0, F.col("one")).otherwise(F.col("zero")).alias("c"))
            at = at.withColumn("p", 1 / (1 + F.exp(-sum((F.col("w")[j] * F.col("z")[j] for j in range(d + 1)), F.lit(0.0)))))
            at = at.withColumn("g", F.col("c") * (F.col("y") - F.col("p"))).withColumn("h", F.col("c") * F.col("p") * (1 - F.col("p")))
            sums = [F.sum(F.col("g") * F.col("z")[j]).alias(f"g{j}") for j in range(d + 1)] + [F.sum(F.col("h") * F.col("z")[i] * F.col("z")[j]).alias(f"h{i}_{j}") for i in range(d + 1) for j in range(i + 1)]
            for r in at.groupBy("fold").agg(*sums).collect():
                m = models[r["fold"]]
                keep = np.append(np.full(d, ridge * m["n"]), 0.0)
                h = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(d + 1)] for i in range(d + 1)]) + np.diag(keep + 1e-12)
                step = np.linalg.solve(h, np.array([r[f"g{j}"] for j in range(d + 1)]) - keep * m["w"])
                m["w"] = m["w"] + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
                m["open"] = np.abs(step).max() > CLOSE
    out = [(f, m["mean"].tolist(), m["scale"].tolist(), m["w"].tolist()) for f, m in models.items()]
    return spark.createDataFrame(out, f"{fold} {kind}, mean array<double>, scale array<double>, w array<double>")


def scored(rows: DataFrame, models: DataFrame, fold: str, features: list[str], name: str = "p") -> DataFrame:
    """rows with their fold's probability; models: a short row a fold, of logistic()."""
    z = sum((F.col("w")[j] * (F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) - F.col("mean")[j]) / F.col("scale")[j] for j, f in enumerate(features)), F.col("w")[len(features)])
    return rows.join(F.broadcast(models), fold).withColumn(name, 1 / (1 + F.exp(-z))).drop("mean", "scale", "w")


def cross_validated(bars: DataFrame, features: list[str], train: int, test: int, n_splits: int, horizon: int, confidence: float) -> tuple[DataFrame, DataFrame]:
    """(symbol, fold, trades, win_rate, profit_factor of each walk-forward fold's unseen rows; mean and sample deviation of them over each symbol's folds).

    bars: symbol, ts, close, features. Every symbol's folds are fitted together; a fold trades its test rows only.
    """
    x = market.labelled(bars, horizon).withColumn("ret", F.col("ahead") / F.col("close") - 1)
    parts = market.folds(x, train, test, n_splits).withColumn("own", F.concat_ws("|", "symbol", "fold"))
    rows = shared.written(parts.join(x.select("symbol", "ts", "label", "ret", *features), ["symbol", "ts"]), "fold-parts")
    models = logistic(rows.where("part = 'train'"), "own", features)
    unseen = scored(rows.where("part = 'test'"), models, "own", features)
    each = market.fold_metrics(unseen.withColumn("symbol_fold", F.col("fold")).drop("fold").withColumnRenamed("own", "fold"), confidence)
    each = unseen.select(F.col("own").alias("fold"), "symbol", F.col("fold").alias("number")).distinct().join(each, "fold", "left").select("symbol", F.col("number").alias("fold"), F.coalesce("trades", F.lit(0)).alias("trades"), "win_rate", "profit_factor")
    each = shared.written(each, "fold-metrics")
    over = [f(c).alias(f"{c}_{name}") for c in ("win_rate", "profit_factor") for f, name in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return each, each.groupBy("symbol").agg(F.count("*").alias("folds"), F.sum("trades").alias("trades"), *over)


def pooled(mean: np.ndarray, weight: np.ndarray) -> list[tuple[int, int, float, float]]:
    """Pool adjacent violators: (first, last, weight, mean) of the blocks, means rising."""
    out: list[list[float]] = []
    for i, (m, w) in enumerate(zip(mean.tolist(), weight.tolist(), strict=True)):
        out.append([i, i, w, m])
        while len(out) > 1 and out[-2][3] >= out[-1][3]:
            _, last, w2, m2 = out.pop()
            out[-1][1:] = [last, out[-1][2] + w2, (out[-1][2] * out[-1][3] + w2 * m2) / (out[-1][2] + w2)]
    return [tuple(x) for x in out]


def isotonic(rows: DataFrame, fold: str, p: str = "p", label: str = "label", per: int = RANGE_VALUES) -> DataFrame:
    """fold, lo, hi, n, value: blocks of rising shares of true labels over scores, of each fold.

    Scores are cut into ranges of values; each range is pooled by itself, then the blocks that are left (a few for each
    range) are pooled across ranges: what violates the order inside a range is in one block of the whole as well.
    """
    kind = rows.schema[fold].dataType.simpleString()
    schema = f"fold {kind}, range double, lo double, hi double, n double, value double"
    y = F.col(label).cast("double")
    values = rows.where(F.col(p).isNotNull() & y.isNotNull()).groupBy(F.col(fold).alias("fold"), F.col(p).cast("double").alias("lo")).agg(F.count("*").cast("double").alias("n"), F.avg(y).alias("value"))
    values = shared.written(values, "scores")
    count = min(values.count() // per, RANGES)
    cuts = sorted(set(values.approxQuantile("lo", [i / count for i in range(1, count)], 0.25 / count))) if count > 1 else []
    number = Bucketizer(splits=[-math.inf, *(cuts or [0.5]), math.inf], inputCol="lo", outputCol="range")

    def pool(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("lo").reset_index(drop=True)
        found = pooled(t.value.to_numpy(), t.n.to_numpy())
        first, last = [b[0] for b in found], [b[1] for b in found]
        return pd.DataFrame({"fold": t.fold.iloc[0], "range": t.range.iloc[0], "lo": t.lo.to_numpy()[first], "hi": t.hi.to_numpy()[last], "n": [b[2] for b in found], "value": [b[3] for b in found]})

    inside = number.transform(values.withColumn("hi", F.col("lo"))).groupBy("fold", "range").applyInPandas(pool, schema)
    return shared.written(inside.groupBy("fold").applyInPandas(pool, schema).drop("range"), "blocks")


def calibrated(rows: DataFrame, blocks: DataFrame, fold: str, p: str = "p", steps: int = 256) -> DataFrame:
    """rows with the value of the block that their score is in; between blocks on the line from one's end to the next's beginning.

    Scores meet blocks by a coarse step of [0, 1] and then by value; a block over many steps stands in each.
    """
    line = W.partitionBy("fold").orderBy("lo")
    step = lambda c: F.floor(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)) * steps)
    spans = blocks.withColumn("from_", F.coalesce(F.lag("hi").over(line), F.lit(float("-inf")))).withColumn("from_value", F.coalesce(F.lag("value").over(line), F.col("value")))
    spans = spans.withColumn("to_", F.when(F.lead("lo").over(line).isNull(), float("inf")).otherwise(F.col("hi")))
    low = F.when(F.col("from_") == float("-inf"), F.lit(0).cast("long")).otherwise(step(F.col("from_")))
    high = F.when(F.col("to_") == float("inf"), F.lit(steps).cast("long")).otherwise(step(F.col("to_")))
    spans = spans.select(F.col("fold").alias("__f"), "from_", "to_", "lo", "value", "from_value", F.explode(F.sequence(low, high)).alias("__s"))
    x = F.col(p).cast("double")
    on = F.col(fold).eqNullSafe(F.col("__f")) & (step(x) == F.col("__s")) & (x > F.col("from_")) & (x <= F.col("to_"))
    share = F.when((x >= F.col("lo")) | (F.col("from_") == float("-inf")), 1.0).otherwise((x - F.col("from_")) / (F.col("lo") - F.col("from_")))
    value = F.col("from_value") + share * (F.col("value") - F.col("from_value"))
    return rows.join(spans, on, "left").withColumn("calibrated", value).select(*[F.col(f"`{c}`") for c in rows.columns], "calibrated")


def calibrated_across(rows: DataFrame, fold: Column, folds: int, p: str = "p", label: str = "label") -> DataFrame:
    """rows with fold (0 .. folds - 1) and calibrated: each by blocks of the other folds' rows."""
    x = rows.withColumn("fold", fold.cast("long"))
    others = x.select(F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long")), lambda i: i != F.col("fold"))).alias("of"), p, label)
    return calibrated(x, isotonic(others, "of", p, label), "fold", p)


def calibration_gain(rows: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """fold, n, and calibration error and Brier score before and after; rows: fold, p, label, calibrated."""
    each = [quality.calibration(rows.select("fold", F.col(c).alias("score"), F.col(label).cast("boolean").alias("label")), ["fold"]).select("fold", "n", F.col("ece").alias(f"ece_{name}"), F.col("brier").alias(f"brier_{name}")) for c, name in ((p, "before"), ("calibrated", "after"))]
    return each[0].join(each[1].drop("n"), "fold")


def area_weights(stacked: DataFrame, label: str = "label") -> DataFrame:
    """model, pr_auc, weight: shares of the models' areas under precision and recall, all from one ranking; equal if all are 0. stacked: model, p, label."""
    from .insight import ranking_metrics

    every = W.partitionBy()  # a row a model
    areas = ranking_metrics(stacked, "model", "p", label).select("model", "pr_auc")
    total = F.sum(F.greatest("pr_auc", F.lit(0.0))).over(every)
    return areas.withColumn("weight", F.when(total > 0, F.greatest("pr_auc", F.lit(0.0)) / total).otherwise(1 / F.count("*").over(every)))


def blended(stacked: DataFrame, weights: DataFrame, row: list[str]) -> DataFrame:
    """row, mean, low and high of the models' scores by their weights."""
    return stacked.join(weights.select("model", "weight"), "model").groupBy(*row).agg(F.sum(F.col("p") * F.col("weight")).alias("mean"), F.min("p").alias("low"), F.max("p").alias("high"))
