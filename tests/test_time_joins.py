"""Joins in time of hot keys: what a row meets is bounded, and results equal a loop over all pairs."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins
from tidemark.plans import registry
from tidemark.streaming import streams

SF = "/root/testdata/sf0.001"
T0 = datetime.datetime(2024, 1, 1)


def test_label_join_of_streams_meets_the_stretches_around(spark, tmp_path):
    """Pairs at the very border count; the streams meet by key and stretch, not by key alone."""
    r, d = random.Random(6), str(tmp_path / "in")
    rows = [(r.choice("ab"), T0 + datetime.timedelta(seconds=60 * r.randrange(60)), i, i % 2) for i in range(200)]
    rows.sort(key=lambda x: x[1])
    for part in (rows[:110], rows[110:]):
        spark.createDataFrame(part, "origin string, ts timestamp, id long, kind int").coalesce(1).write.mode("append").parquet(d)
        e = spark.readStream.schema("origin string, ts timestamp, id long, kind int").parquet(d)
        labels = e.where("kind = 0").select("origin", "ts", F.col("id").alias("event_id"))
        decisions = e.where("kind = 1").select(F.col("origin").alias("r_origin"), F.col("ts").alias("r_ts"), F.col("id").alias("h_id"))
        joined = streams.labels_with_decisions(labels, decisions, 120)
        assert joined.columns == ["origin", "ts", "event_id", "r_origin", "r_ts", "h_id"]
        got = streams.run_available(joined, f"file://{tmp_path}/out")
    want = [(a[2], b[2]) for a in rows for b in rows if a[3] == 0 and b[3] == 1 and a[0] == b[0] and abs((a[1] - b[1]).total_seconds()) <= 120]
    assert sorted((x["event_id"], x["h_id"]) for x in got.collect()) == sorted(want)
    assert "stretch" in next(x for x in joined._jdf.queryExecution().analyzed().toString().splitlines() if "Join" in x)


def nearest_rows(left, right, seconds):
    out = {}
    for k, ts, i in left:
        near = sorted((abs((u - ts).total_seconds()), u, j) for p, u, j in right if k is not None and ts and u and p == k and abs((u - ts).total_seconds()) <= seconds)
        out |= {i: near[0][2]} if near else {}
    return out


def test_nearest_over_stretches_and_ties(spark):
    """Times in steps of a minute, so that many tie and many lie at the very border; nulls, and times before 1970."""
    r = random.Random(7)
    for start, minutes in ((T0, 40), (T0, 600), (datetime.datetime(1969, 12, 31, 22), 240)):
        t = lambda: start + datetime.timedelta(minutes=r.randrange(minutes))  # noqa: E731, B023
        left = [(r.choice("abz"), t(), i) for i in range(150)] + [("a", None, 150), (None, t(), 151)]
        right = [(r.choice("ab"), t(), i) for i in r.sample(range(1000), 120)] + [("a", None, 1000), (None, t(), 1001)]
        got = joins.nearest(spark.createDataFrame(left, "k string, ts timestamp, id long"), spark.createDataFrame(right, "k string, r_ts timestamp, r_seq long"), "k", 300, "id")
        assert got.columns == ["k", "ts", "id", "r_ts", "r_seq"]
        assert {x["id"]: x["r_seq"] for x in got.collect()} == nearest_rows(left, right, 300)


def test_nearest_makes_no_pairs(spark):
    """A thousand rows of each side at once: what is sorted are the rows, not their pairs."""
    rows = spark.range(1000)
    left = rows.select(F.lit("a").alias("k"), F.lit(T0).alias("ts"), "id")
    right = rows.select(F.lit("a").alias("k"), F.lit(T0).alias("r_ts"), F.col("id").alias("r_seq"))
    got = joins.nearest(left, right, "k", 300, "id")
    assert got.agg(F.count("*"), F.min("r_seq"), F.max("r_seq")).first()[:] == (1000, 0, 0)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")
def test_disagreements_are_matched_once(spark):
    """What the forest is fitted on and what it scores are read from one table, not matched anew in each pass."""
    got = registry.QUERIES["disagreement_model"](spark, SF)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    matched = registry.QUERIES["nearest_label_join"](spark, SF).count()
    assert 0 < got.count() < matched


def sorts(plan):
    return [x for x in plan.splitlines() if " Sort [" in x and "__t#" in x]


def test_nearest_sorts_once(spark):
    """Last before and first after come from one sort: a task holds its rows once, not once a direction."""
    left = spark.range(3).select(F.lit("a").alias("k"), F.lit(T0).alias("ts"), "id")
    right = spark.range(3).select(F.lit("a").alias("k"), F.lit(T0).alias("r_ts"), F.col("id").alias("r_seq"))
    plan = joins.nearest(left, right, "k", 300, "id")._jdf.queryExecution().executedPlan().toString()
    assert len(sorts(plan)) == 1


def test_nearest_in_a_stretch_of_many_rows(spark):
    """More rows in one stretch than a window keeps in its first buffer, many at one time, and places without an earlier or later one."""
    r = random.Random(8)
    at = lambda lo, hi: T0 + datetime.timedelta(seconds=r.randrange(lo, hi))
    left, right = [("a", at(0, 1200), i) for i in range(5000)], [("a", at(200, 900), i) for i in r.sample(range(9000), 6000)]
    first = {}
    for _, u, j in right:
        first[u] = min(j, first.get(u, j))
    want = {}
    for _, t, i in left:
        near = min((abs((u - t).total_seconds()), u) for u in first)
        want |= {i: (near[1], first[near[1]])} if near[0] <= 100 else {}
    got = joins.nearest(spark.createDataFrame(left, "k string, ts timestamp, id long"), spark.createDataFrame(right, "k string, r_ts timestamp, r_seq long"), "k", 100, "id")
    assert {x["id"]: (x["r_ts"], x["r_seq"]) for x in got.collect()} == want


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["bootstrap_brier_deviation", "held_out_calibration", "quality_per_version", "calibration_per_origin", "calibration_per_version", "performance_trend", "threshold_quality", "disagreement_lists", "model_lineage", "precision_threshold", "ranking_metrics", "reliability_bins", "threshold_what_if"])
def test_queries_match_by_one_sort(spark, monkeypatch, name):
    """What the query's labels are matched by: no pairs, and one sort of both sides."""
    made, real = [], joins.nearest
    monkeypatch.setattr(joins, "nearest", lambda *a: made.append(real(*a)) or made[-1])
    registry.QUERIES[name](spark, SF)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in made]
    assert plans and all(len(sorts(x)) == 1 and "Join" not in x for x in plans)
