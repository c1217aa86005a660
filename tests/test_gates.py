"""Gates against the plain loop: random rows, ties, nulls, one symbol without a pause, and the plan of the work."""

import datetime
import random

import numpy as np
import pytest

from tidemark.operators import gates, market

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + datetime.timedelta(seconds=seconds)


def loop(rows, width, passes):
    """rows: (symbol, seconds, id, value)."""
    out, last = [], {}
    for s, t, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        if t is None:
            out.append((s, t, i, v))
        elif s not in last or t - last[s][0] >= width or passes(last[s][1], v):
            out.append((s, t, i, v))
            last[s] = (t, v)
    return sorted(out, key=repr)


def made(seed, n, span, flips):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice(["A", "A", "A", "B", None])
        t = None if rng.random() < 0.02 else rng.randrange(span) + rng.choice([0, 0, 3 * span if s == "B" else 0])
        rows.append((s, t, i, rng.choice(["up", "down", "down", None] if rng.random() < 0.1 else ["up", "down"]) if flips else round(8 + rng.gauss(0, 0.8), 2)))
    return rows


def run(spark, rows, gate, order, **kw):
    kind = "string" if gate.value == "direction" else "double"
    df = spark.createDataFrame([(s, at(t), i, v) for s, t, i, v in rows], f"symbol string, ts timestamp, event_id long, {gate.value} {kind}").repartition(5)
    got = gates.kept(df, gate, order, **kw)
    assert got.columns == df.columns
    return sorted(((r[0], None if r[1] is None else int((r[1] - T0).total_seconds()), r[2], r[3]) for r in got.collect()), key=repr)


@pytest.mark.parametrize(("seed", "n", "span", "per", "fan"), [(1, 400, 4000, 4096, 256), (2, 700, 9000, 8, 3), (3, 300, 60000, 4, 2), (4, 900, 1200, 2, 2), (5, 60, 3_000_000, 1, 4)])
def test_against_the_loop(spark, seed, n, span, per, fan):
    rows = made(seed, n, span, True)
    assert run(spark, rows, gates.min_flip(5), ["event_id", "direction"], per=per, fan=fan) == loop(rows, 300, lambda a, b: a is None or b is None or a == b)
    rows = made(seed + 100, n, span, False)
    assert run(spark, rows, gates.cooldown(5, 1.5), ["event_id"], per=per, fan=fan) == loop(rows, 300, lambda a, b: abs(b - a) >= 1.5)


def test_one_symbol_without_a_pause(spark):
    """A symbol with an alert each second for half a day: many buckets, all of them of bounded size."""
    rng = np.random.default_rng(8)
    n = 43_200
    moves = 9 + np.cumsum(rng.normal(0, 0.2, n)) % 3
    rows = [("A", i, i, float(v)) for i, v in enumerate(moves)]
    want = loop(rows, 1800, lambda a, b: abs(b - a) >= 2)
    df = spark.createDataFrame([(s, at(t), i, v, 20.0) for s, t, i, v in rows], "symbol string, ts timestamp, event_id long, move double, volume double")
    got = market.cooldown(df)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r[2] for r in want)


def test_empty_and_untimed(spark):
    schema = "symbol string, ts timestamp, event_id long, direction string"
    assert gates.kept(spark.createDataFrame([], schema), gates.min_flip(5), ["event_id"]).count() == 0
    assert gates.kept(spark.createDataFrame([("A", None, 1, "up"), ("A", None, 2, "down")], schema), gates.min_flip(5), ["event_id"]).count() == 2


def test_path(spark):
    """The real entries through random maps, in blocks of three."""
    rng = random.Random(3)
    steps, want = [], []
    for key in (1, 2):
        here, entries = gates.START, [gates.START]
        for pos in range(40 if key == 1 else 1):
            exits = rng.sample(range(50), 5)
            of = {e: rng.choice(exits) for e in entries}
            steps += [(key, pos, e, x) for e, x in of.items()]
            want.append((key, pos, here))
            here, entries = of[here], exits
    df = spark.createDataFrame(steps, "key long, pos long, entry long, exit long")
    assert sorted(map(tuple, gates.path(df, 3).select("key", "pos", "entry").collect())) == want


def test_in_many_partitions(spark):
    """Buckets, entries and maps meet whatever the number of shuffle partitions."""
    rows = made(11, 600, 9000, True)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, rows, gates.min_flip(5), ["event_id", "direction"], per=16, fan=3) == loop(rows, 300, lambda a, b: a is None or b is None or a == b)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
