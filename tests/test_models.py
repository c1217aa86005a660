"""Models on small tables where the right answer is known."""

import math

import pytest

from tidemark.operators import models
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored(spark):
    """Scores 0.00 .. 0.99; the true share is 0.2 below 0.5 and 0.9 from there on."""
    rows = [(i / 100, float(j < (2 if i < 50 else 9))) for i in range(100) for j in range(10)]
    return spark.createDataFrame(rows, "p double, label double")


@pytest.mark.parametrize("kind", ["isotonic", "sigmoid"])
def test_calibration(scored, kind):
    got = models.calibrate(models.calibrated(scored, kind=kind), scored).groupBy("p").agg({"calibrated": "avg"}).collect()
    at = {round(r["p"], 2): r[1] for r in got}
    values = [at[k] for k in sorted(at)]
    assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1
    if kind == "isotonic":
        assert all(math.isclose(v, 0.2 if k < 0.5 else 0.9, abs_tol=1e-6) for k, v in at.items())
    else:
        assert at[0.1] < 0.3 and at[0.9] > 0.8


def test_calibration_of_no_such_kind(scored):
    with pytest.raises(ValueError):
        models.calibrated(scored, kind="other")


@pytest.mark.parametrize("kind", ["lr", "rf", "gb"])
def test_classifiers_tell_a_plain_rule(spark, kind, monkeypatch):
    monkeypatch.setattr(models, "GBTClassifier", lambda maxIter, **k: __import__("pyspark.ml.classification").ml.classification.GBTClassifier(maxIter=10, **k))
    monkeypatch.setattr(models, "RandomForestClassifier", lambda numTrees, **k: __import__("pyspark.ml.classification").ml.classification.RandomForestClassifier(numTrees=10, **k))
    rows = spark.createDataFrame([(i, float(i % 10), float(i % 7), float(i % 10 >= 5)) for i in range(200)], "id int, a double, b double, label double")
    got = models.probability(models.train(rows, ["a", "b"], kind), rows).collect()
    assert all((r["p"] >= 0.5) == bool(r["label"]) for r in got)


def test_evaluated(scored):
    got = models.evaluated(scored)
    assert got["roc_auc"] > 0.7 and got["log_loss"] > 0 and 0 < got["brier"] < 1
    one = models.evaluated(scored.where("label = 1"))
    assert one["roc_auc"] == 0.5 and one["pr_auc"] == 1.0


def test_regime_without_rows_takes_the_common_model(spark):
    rows = [(float(i % 10), "up" if i % 2 else "down", float((i % 10 >= 5) == bool(i % 2))) for i in range(200)] + [(9.0, "rare", 1.0)] * 5
    df = spark.createDataFrame(rows, "x double, regime string, label double")
    got = models.by_regime(df, ["x"], df).collect()
    assert len(got) == len(rows)
    assert all((r["p"] >= 0.5) == bool(r["label"]) for r in got if r["regime"] != "rare")
    common = models.probability(models.train(df, ["x"]), df.where("regime = 'rare'")).first()["p"]
    assert all(r["p"] == pytest.approx(common) for r in got if r["regime"] == "rare")


def test_maps_become_columns(spark):
    log = spark.createDataFrame([(1, {"b": 2.0}, 1.0), (2, {"a": 1.0, "c": 3.0}, 0.0), (3, None, 1.0)], "id int, f map<string, double>, label double")
    rows, names = models.from_maps(log, "id", "f", ["label"])
    assert names == ["a", "b", "c"] and {tuple(r) for r in rows.collect()} == {(1, 1.0, 0.0, 2.0, 0.0), (2, 0.0, 1.0, 0.0, 3.0), (3, 1.0, 0.0, 0.0, 0.0)}


def test_ensemble_weights():
    assert models.pr_weights({"a": 0.3, "b": 0.1}) == {"a": pytest.approx(0.75), "b": pytest.approx(0.25)}
    assert models.pr_weights({"a": 0.0, "b": 0.0}) == {"a": 0.5, "b": 0.5}


@pytest.mark.parametrize("name", ["per_regime_model", "retrained_from_log", "disagreement_model", "text_disagreement", "trained_direction_model"])
def test_model_queries_give_probabilities(spark, name):
    df = registry.QUERIES[name](spark, SF)
    p = "p_long" if "p_long" in df.columns else "p"
    rows = df.collect()
    assert rows and all(0 <= r[p] <= 1 for r in rows)
