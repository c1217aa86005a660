"""Proposed thresholds: no task holds an origin's scores, and an origin without any score is kept."""

import datetime
import random

import duckdb

from tidemark.plans import registry

T0 = datetime.datetime(2024, 1, 1)


def test_recommended_thresholds_are_searched(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, T0 + datetime.timedelta(seconds=r.randrange(90_000)), i % 2, r.choice(["click", "purchase"]), r.uniform(0, 300), f'{{"k": {r.randrange(100)}}}') for i in range(3000)]
    rows += [(3000 + i, T0, 2, "click", None, '{"k": 1}') for i in range(3)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["threshold_auto_apply"](spark, str(tmp_path))
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(f"select origin, decision, threshold from ({registry.ORACLES['threshold_auto_apply']})").fetchall()
    assert len(want) == 3
    assert sorted(map(repr, (tuple(x) for x in got.select("origin", "decision", "threshold").collect()))) == sorted(map(repr, want))
