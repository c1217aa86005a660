"""Streams against their batch form where a group or its alerts do not come at once."""

import datetime
import random

import pyarrow as pa
import pyarrow.parquet as pq

from tidemark.plans import registry
from tidemark.streaming import streams

T0 = datetime.datetime(2024, 1, 1)


def events(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(path)


def random_rows(seed, first, start):
    r = random.Random(seed)
    return [(first + i, T0 + datetime.timedelta(seconds=start + r.randrange(20_000)), 1, r.choice("ab"), r.choice([70.0, 80.0, 95.0]), '{"k": 20}') for i in range(60)]


def accepted(rows):
    last, kept = {}, []
    for i, ts, _, symbol, value, _ in sorted(rows, key=lambda x: (x[1], x[0])):
        move, at = value / 10, last.get(symbol)
        if at is None or (ts - at[0]).total_seconds() >= 1800 or abs(move - at[1]) >= 2:
            last[symbol] = (ts, move)
            kept.append((symbol, i))
    return sorted(kept)


def test_cooldown_of_a_group_in_many_arrow_parts(spark, tmp_path):
    rows, d = random_rows(1, 0, 0), str(tmp_path)
    columns = dict(zip(("event_id", "ts", "user_id", "event_type", "value", "props"), zip(*rows), strict=True))
    pq.write_table(pa.table(columns), f"{d}/events.parquet")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        for name in ("streamed_cooldown", "alert_cooldown"):
            assert sorted(tuple(x) for x in registry.QUERIES[name](spark, d).select("symbol", "event_id").collect()) == accepted(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_cooldown_is_carried_between_batches(spark, tmp_path):
    a, b = random_rows(2, 0, 0), random_rows(3, 100, 20_001)
    d = str(tmp_path / "in")
    for rows in (a, b):
        events(spark, d, rows)
        raw = spark.readStream.schema(streams.EVENTS).parquet(d).withColumn("ts", streams.F.col("ts").cast("timestamp"))
        alerts = raw.selectExpr("event_id", "event_type as symbol", "ts", "value / 10 as move")
        got = streams.run_cooled(alerts, f"file://{tmp_path}/out", 30, 2.0)
    assert sorted((x["symbol"], x["event_id"]) for x in got.collect()) == accepted(a + b)


def test_cooldown_without_alerts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    raw = spark.readStream.schema("symbol string, ts timestamp, event_id long, move double").parquet(f"file://{tmp_path}/in")
    assert streams.run_cooled(raw, f"file://{tmp_path}/out", 30, 2.0).count() == 0


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path):
    """A second batch with an hour that closed long ago and one that did not: the closed one's count stays as it was."""
    d, hour = str(tmp_path / "in"), lambda i, h, m=0: (i, T0 + datetime.timedelta(hours=h, minutes=m), 1, "a", 1.0, "{}")
    (tmp_path / "in").mkdir()
    batches = [[hour(1, 0), hour(2, 0, 5), hour(3, 30)], [hour(4, 0, 10), hour(5, 30, 1), hour(6, 29, 30)], [hour(7, 60)]]
    for rows in batches:
        events(spark, d, rows)
        raw = spark.readStream.schema(streams.EVENTS).parquet(d).withColumn("ts", streams.F.col("ts").cast("timestamp"))
        got = streams.run_available(streams.tumbling(raw), f"file://{tmp_path}/out")
    found = {(x["bucket"].replace(tzinfo=None) - T0).total_seconds() / 3600: x["n"] for x in got.collect()}
    assert found == {0: 2, 30: 2, 29: 1}


def test_ingest_appends_what_comes(spark, tmp_path):
    d = str(tmp_path / "in")
    events(spark, d, random_rows(4, 0, 0))
    raw = spark.readStream.schema(streams.EVENTS).parquet(d)
    for k in (1, 2):
        q = streams.append_parquet(raw, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "0 seconds")
        q.processAllAvailable()
        q.stop()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 60 * k
        if k == 1:
            events(spark, d, random_rows(5, 100, 0))


def test_no_rows_yet(spark, tmp_path):
    (tmp_path / "in").mkdir()
    raw = spark.readStream.schema(streams.EVENTS).parquet(f"file://{tmp_path}/in").withColumn("ts", streams.F.col("ts").cast("timestamp"))
    for mode in ("append", "complete"):
        assert streams.run_available(streams.tumbling(raw), f"file://{tmp_path}/{mode}", mode).count() == 0


def nearest(labels, decisions, seconds):
    out = set()
    for o, t, i in labels:
        near = sorted((abs((u - t).total_seconds()), u, j) for p, u, j in decisions if p == o and abs((u - t).total_seconds()) <= seconds)
        out |= {(i, near[0][2])} if near else set()
    return out


def test_nearest_labels_over_batches_and_restarts(spark, tmp_path):
    """Labels before and after their decisions, in several batches of several runs; each is answered once, the last ones by a later row."""
    r = random.Random(4)
    rows = [(r.choice("ab"), T0 + datetime.timedelta(seconds=s // 3 * 60 + r.randrange(200)), 1000 + s, r.choice([0, 1])) for s in range(240)]
    schema, d = "origin string, ts timestamp, id long, kind int", str(tmp_path / "in")
    parts = [sorted(rows, key=lambda x: x[1])[i : i + 60] for i in range(0, 240, 60)]
    got = None
    for part in [*parts, [("z", T0 + datetime.timedelta(days=1), 1, 0)]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(d)
        e = spark.readStream.schema(schema).parquet(d)
        found = streams.nearest_labels(e.where("kind = 0").withColumnRenamed("id", "event_id"), e.where("kind = 1").withColumnRenamed("id", "h_id"), 120)
        got = streams.run_available(found, f"file://{tmp_path}/out")
    pairs = [(x["event_id"], x["h_id"]) for x in got.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == nearest([x[:3] for x in rows if x[3] == 0], [x[:3] for x in rows if x[3] == 1], 120)


def test_every_tenth_failure_alerts(spark, tmp_path):
    import time

    rows = [(i, "feed" if i % 3 else "store", i % 2 == 0) for i in range(100)]
    alerts, d = [], str(tmp_path / "in")
    listener = streams.FailureAlerts(["feed", "store"], lambda c, n: alerts.append((c, n)))
    spark.streams.addListener(listener)
    try:
        for part in (rows[:50], rows[50:]):
            spark.createDataFrame(part, "id long, component string, failed boolean").coalesce(1).write.mode("append").parquet(d)
            stream = listener.observed(spark.readStream.schema("id long, component string, failed boolean").parquet(d), "component", streams.F.col("failed"))
            streams.run_available(stream, f"file://{tmp_path}/out")
        want = {c: sum(1 for _, x, f in rows if x == c and f) for c in ("feed", "store")}
        for _ in range(100):
            if listener.counts == want:
                break
            time.sleep(0.1)
        assert listener.counts == want
        assert sorted(alerts) == sorted((c, n) for c in want for n in range(10, want[c] + 1, 10))
    finally:
        spark.streams.removeListener(listener)
