"""Queries against their SQL in DuckDB on the smallest tables, and cases worked out by hand."""

import datetime
import math
import os

import duckdb
import pytest

from tidemark.functions import scalars
from tidemark.operators import joins, market, origins, quality
from tidemark.plans import registry
from tidemark.sources import ledgers, sinks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 8) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    cur = db.execute(registry.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def at(s):
    return datetime.datetime.fromisoformat(s)


def test_burst_by_hand(spark):
    """Once an hour for ten hours, ten times in hour 12 of 24: z is about 4.648."""
    rows = [("a", at(f"2024-01-01T{h:02d}:10:00")) for h in range(10)] + [("a", at("2024-01-01T12:00:00"))] * 10
    df = spark.createDataFrame(rows, "origin string, ts timestamp")
    got = origins.bursts(df, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "hour", 2.0).collect()
    assert [(r["bucket"].hour, r["n"], round(r["z"], 3)) for r in got] == [(12, 10, 4.648)]


def test_lead_lag_by_hand(spark):
    base = [0, 1, 3, 5, 4, 3, 2, 1, 0, 1]
    rows = [(o, at("2024-01-01T00:30:00") + datetime.timedelta(hours=i + shift)) for o, shift in (("a", 0), ("b", 3)) for i, n in enumerate(base) for _ in range(n)]
    got = {(r["a"], r["b"]): r for r in origins.lead_lag(spark.createDataFrame(rows, "origin string, ts timestamp"), "hour", 6).collect()}
    assert got["a", "b"]["best_lag"] == 3 and got["a", "b"]["leader"] == "a" and got["a", "b"]["r"] > 0.6


def test_constant_series_have_no_correlation(spark):
    rows = [(o, at(f"2024-01-0{d}T00:00:00")) for d in (1, 2, 3) for o in ("a", "b")]
    assert [r["r"] for r in origins.correlations(spark.createDataFrame(rows, "origin string, ts timestamp"), "day").collect()] == [0.0]


def test_nearest_prefers_the_earlier(spark):
    left = spark.createDataFrame([("x", at("2024-01-01T00:05:00"), 1), ("x", at("2024-01-01T01:00:00"), 2)], "k string, ts timestamp, id int")
    right = spark.createDataFrame([("x", at("2024-01-01T00:08:00"), 1), ("x", at("2024-01-01T00:02:00"), 2), ("y", at("2024-01-01T00:05:00"), 3)], "k string, r_ts timestamp, r_seq int")
    assert [(r["id"], r["r_seq"]) for r in joins.nearest(left, right, "k", 300, "id").collect()] == [(1, 2)]


def test_greedy_matches_differ(spark):
    labels = spark.createDataFrame([("x", at("2024-01-01T00:00:00"), 1, True), ("x", at("2024-01-01T00:02:00"), 2, True)], "origin string, ts timestamp, event_id long, label boolean")
    decisions = spark.createDataFrame([("x", at("2024-01-01T00:01:30"), 10), ("x", at("2024-01-01T00:04:00"), 11)], "origin string, ts timestamp, event_id long")
    pairs = lambda df: sorted((r["label_id"], r["decision_id"]) for r in df.collect())
    assert pairs(quality.greedy_by_trigger(labels, decisions)) == [(1, 11), (2, 10)]
    assert pairs(quality.greedy_by_label(labels, decisions)) == [(1, 10), (2, 11)]


def test_timestamps(spark):
    df = spark.createDataFrame([("1704164645.25",), ("2024-01-02T03:04:05.25Z",), ("2024-01-02T03:04:05.25",), ("bad",), (None,)], "x string")
    got = [r[0] for r in df.select(scalars.parse_ts(df.x)).collect()]
    assert got[0] == got[1] == got[2] and got[3] is got[4] is None


def test_interval_is_checked(spark):
    with pytest.raises(ValueError):
        scalars.bucket(spark.range(1).id, "week")


def test_ledgers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2, "b": 3}\n')
    path = str(tmp_path / "a.jsonl")
    assert sorted(r["a"] for r in ledgers.read(spark, path, "a int").collect()) == [1, 2]
    assert ledgers.read(spark, path, "a int", "all_or_nothing").count() == 0
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        ledgers.read(spark, path, "a int", "strict").collect()
    assert ledgers.read(spark, str(tmp_path / "none"), "a int").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    sinks.append_json(df, str(tmp_path / "j"), "now")
    sinks.append_json(df, str(tmp_path / "j"), "now")
    assert spark.read.json(str(tmp_path / "j")).where("timestamp = 'now'").count() == 4
    sinks.export_csv(df, str(tmp_path / "c"), ["v"], "id = 1")
    assert [r["v"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == ["x"]
    sinks.snapshot(df, str(tmp_path / "s"))
    assert sinks.manifest(spark, str(tmp_path / "s")).count() >= 1


def test_backtest_by_hand(spark):
    rows = [("a", at("2024-01-01T00:00:00") + datetime.timedelta(hours=i), c, p) for i, (c, p) in enumerate([(100.0, 0.9), (100.0, 0.1), (110.0, 0.1), (120.0, 0.1)])]
    got = market.backtest(spark.createDataFrame(rows, "symbol string, ts timestamp, close double, p double"), 0.7, 1, 2, 0, 0).collect()
    assert [(r["trades"], round(r["equity"], 6)) for r in got] == [(1, 1.2)]
