"""The bootstrap's mean and deviation against resamples worked out row by row."""

import hashlib
import math
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import models
from tidemark.plans import quality_queries, registry

SF = "/root/testdata/sf0.001"
STEPS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(6)]


def by_hand(rows, times=30):
    """Mean and sample deviation over resamples, each row taken as often as its hash says."""
    u = {(r["row"], t): int(hashlib.md5(f"{r['row']}:{t}".encode()).hexdigest()[:8], 16) / 2**32 for r in rows for t in range(1, times + 1)}
    briers = []
    for t in range(1, times + 1):
        taken = [r for r in rows for _ in range(sum(u[r["row"], t] > c for c in STEPS))]
        if taken:
            briers.append(math.fsum((r["score"] - r["label"]) ** 2 for r in taken) / len(taken))
    return statistics.mean(briers), statistics.stdev(briers)


def test_bootstrap_on_a_fixture(spark):
    df = spark.createDataFrame([(i, (i * 37 % 100) / 100, i % 3 == 0) for i in range(80)], "row long, score double, label boolean")
    got = models.bootstrap(df, 30, "score").first()
    assert (got["mean"], got["std"]) == pytest.approx(by_hand(df.collect()), abs=1e-9)
    assert got["std"] > 0.005


def test_query_returns_the_resamples(spark):
    p = quality_queries.pairs(spark, SF).select(F.col("event_id").alias("row"), "score", "label").collect()
    x = registry.QUERIES["bootstrap_brier_deviation"](spark, SF).first()
    assert (x["mean"], x["std"]) == pytest.approx(by_hand(p), abs=1e-6) and x["n"] == len(p) and x["resamples"] == 30
