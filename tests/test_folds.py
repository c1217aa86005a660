"""Fits of all folds at once against single fits, calibration against brute force, weights from areas, and metrics on unseen rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


def newton(x, y, ridge=folds.RIDGE, rounds=200):
    mean, scale = x.mean(0), x.std(0, ddof=1)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    n, k = len(y), y.sum()
    c, keep, w = np.where(y > 0, n / (2 * k), n / (2 * (n - k))), np.append(np.full(x.shape[1], ridge * n), 0.0), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + 0.5 * np.linalg.solve((z * (c * p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (c * (y - p)) - keep * w)
    return w


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 3)) * [1, 20, 0.01] + [0, 5, 1]
    y = (rng.random(240) < 1 / (1 + np.exp(-(x[:, 0] * 1.5 + x[:, 1] * 0.05)))).astype(float)
    return [(int(i % 4), i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]


def test_all_folds_at_once(spark, rows):
    """Each fold's weights are those of its own fit by plain Newton steps, whatever other folds are there."""
    df = spark.createDataFrame(rows, "part long, id long, a double, b double, c double, label double")
    train = df.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i != F.col("part"))).alias("fold"))
    got = {r["fold"]: np.array(r["w"]) for r in folds.logistic(train, "fold", ["a", "b", "c"]).collect()}
    for f in range(4):
        mine = np.array([r for r in rows if r[0] != f])
        assert np.allclose(got[f], newton(mine[:, 2:5], mine[:, 5]), atol=1e-7)
    one = folds.logistic(train.where("fold = 2"), "fold", ["a", "b", "c"])
    assert np.allclose(one.first()["w"], got[2], atol=1e-9)
    p = folds.scored(df.where("part = 2").withColumn("fold", F.lit(2)), one, "fold", ["a", "b", "c"]).collect()
    mine = np.array([r for r in rows if r[0] != 2])
    z = lambda r: np.append((np.array(r) - mine[:, 2:5].mean(0)) / mine[:, 2:5].std(0, ddof=1), 1.0)
    assert all(math.isclose(r["p"], 1 / (1 + math.exp(-z([r["a"], r["b"], r["c"]]) @ got[2])), abs_tol=1e-9) for r in p)


def test_fold_of_one_class_and_constant_feature(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0, 1.0), (0, 2.0, 5.0, 1.0), (1, 1.0, 5.0, 0.0), (1, 2.0, 5.0, 1.0), (1, 3.0, 5.0, 1.0), (1, 1.5, 5.0, None)], "fold int, a double, b double, label double")
    got = {r["fold"]: r["w"] for r in folds.logistic(df, "fold", ["a", "b"]).collect()}
    assert got[0][:2] == [0.0, 0.0] and math.isclose(got[0][2], math.log(2.5 / 0.5))
    assert got[1][0] > 0 and abs(got[1][1]) < 1e-9


def test_cross_validation_learns_only_from_before(spark):
    """A feature that tells the next hour in the first folds and lies afterwards: unseen trades lose where it lies."""
    rng, close, rows = random.Random(1), 100.0, []
    for i in range(400):
        up = rng.random() < 0.5
        tell = (1.0 if up else -1.0) * (1 if i < 280 else -1)
        rows.append(("s", i, close, tell, rng.random()))
        close *= 1.01 if up else 0.99
    df = spark.createDataFrame(rows, "symbol string, i long, close double, tell double, noise double").withColumn("ts", F.timestamp_seconds(F.col("i") * 3600))
    each, over = folds.cross_validated(df.drop("i"), ["tell", "noise"], 200, 60, 3, 1, 0.55)
    got = {r["fold"]: r for r in each.collect()}
    assert sorted(got) == [0, 1, 2] and got[0]["win_rate"] == 1.0
    assert all(0 <= r["win_rate"] <= 1 and r["trades"] <= 60 for r in got.values())
    r, rates = over.first(), [x["win_rate"] for x in got.values()]
    assert r["folds"] == 3 and math.isclose(r["win_rate_mean"], np.mean(rates)) and math.isclose(r["win_rate_std"], np.std(rates, ddof=1), abs_tol=1e-12)


def isotone(p, y):
    """The best rising fit by the max-min formula over distinct scores."""
    xs = sorted(set(p))
    n = [sum(a == x for a in p) for x in xs]
    s = [sum(t for a, t in zip(p, y, strict=True) if a == x) for x in xs]
    mean = lambda i, j: sum(s[i : j + 1]) / sum(n[i : j + 1])
    return {x: max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("per", [4, 1 << 14])
def test_isotonic_fit(spark, per):
    rng = random.Random(5)
    rows = [(f, round(rng.random(), 2), None) for f in (0, 1) for _ in range(150)]
    rows = [(f, p, float(rng.random() < (p**2 if f else 1 - p))) for f, p, _ in rows]
    df = spark.createDataFrame(rows, "fold long, p double, label double").repartition(4)
    blocks = folds.isotonic(df, "fold", per=per)
    got = folds.calibrated(df, blocks, "fold").collect()
    assert len(got) == len(rows)
    for f in (0, 1):
        mine = [(p, y) for g, p, y in rows if g == f]
        want = isotone([p for p, _ in mine], [y for _, y in mine])
        assert all(math.isclose(r["calibrated"], want[r["p"]], abs_tol=1e-9) for r in got if r["fold"] == f)
    beyond = folds.calibrated(spark.createDataFrame([(0, -3.0), (0, 7.0), (1, 0.123456)], "fold long, p double"), blocks, "fold").collect()
    assert len(beyond) == 3 and all(0 <= r["calibrated"] <= 1 for r in beyond)


def test_calibration_across_folds_helps_scores_that_lie(spark):
    rng = random.Random(8)
    rows = [(i, p, rng.random() < p * 0.3) for i, p in ((i, rng.random()) for i in range(3000))]
    df = spark.createDataFrame(rows, "id long, p double, label boolean")
    across = folds.calibrated_across(df, F.col("id") % 3, 3)
    gain = folds.calibration_gain(across).collect()
    assert across.count() == 3000 and len(gain) == 3
    assert all(r["ece_after"] < 0.06 < 0.25 < r["ece_before"] and r["brier_after"] < r["brier_before"] for r in gain)


def test_area_weights(spark):
    """A perfect score, an idle one and a wrong one."""
    rows = [(m, {"good": i, "flat": 1, "bad": -i}[m] / 10, i >= 6) for m in ("good", "flat", "bad") for i in range(10)]
    got = {r["model"]: r for r in folds.area_weights(spark.createDataFrame(rows, "model string, p double, label boolean")).collect()}
    assert got["good"]["pr_auc"] == 1.0 and got["flat"]["pr_auc"] == 0.4 and got["bad"]["pr_auc"] < 0.4
    assert math.isclose(sum(r["weight"] for r in got.values()), 1) and got["good"]["weight"] > got["flat"]["weight"] > got["bad"]["weight"]


@pytest.mark.parametrize("name", ["trained_ensemble", "held_out_calibration", "live_backtest_model", "fitted_thresholds_model", "cross_validated_summary", "trained_direction_model", "per_regime_model", "retrained_from_log", "disagreement_model", "text_disagreement"])
def test_queries_run_on_unseen_rows(spark, name):
    got = registry.QUERIES[name](spark, SF).collect()
    if name == "trained_ensemble":
        assert math.isclose(sum(r["weight"] for r in got), 1, abs_tol=1e-5) and all(0 < r["pr_auc"] <= 1 for r in got)
    if name == "held_out_calibration":
        assert all(r["ece_after"] <= r["ece_before"] + 0.1 for r in got)
    if name == "text_disagreement":
        assert 0 < len(got) < 60
