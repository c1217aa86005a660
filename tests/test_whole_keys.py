"""Operators in time by key: no key's rows are gathered, and results equal a loop over them."""

import datetime
import random

from tidemark.operators import governance, joins, market

T0 = datetime.datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().toString()


def signals(spark, n, seconds):
    r = random.Random(n)
    rows = [("a" if r.random() < 0.8 else "b", T0 + datetime.timedelta(seconds=r.randrange(seconds)), i, r.choice(["long", "short"]), r.choice([7.0, 8.0, 9.5, 10.0]), 20.0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "symbol string, ts timestamp, event_id long, direction string, move double, volume double")


def loop(rows, passes):
    last, kept = {}, []
    for x in sorted(rows, key=lambda x: (x[1], x[2])):
        if x[0] not in last or passes(last[x[0]], x):
            last[x[0]] = x
            kept.append(x[2])
    return sorted(kept)


def ids(df):
    return sorted(r["event_id"] for r in df.collect())


def test_min_flip_gathers_no_symbol(spark):
    for n, seconds in ((300, 40 * 3600), (300, 400 * 3600)):
        rows, df = signals(spark, n, seconds)
        got = market.min_flip(df, 120)
        assert ids(got) == loop(rows, lambda a, b: a[3] == b[3] or (b[1] - a[1]).total_seconds() >= 7200)
        assert "collect_list" not in plan(got)


def test_cooldown_gathers_no_symbol(spark):
    for n, seconds in ((300, 10 * 3600), (300, 200 * 3600)):
        rows, df = signals(spark, n, seconds)
        got = market.cooldown(df)
        assert ids(got) == loop(rows, lambda a, b: (b[1] - a[1]).total_seconds() >= 1800 or abs(a[4] - b[4]) >= 2)
        assert "FlatMapGroupsInPandas" not in plan(got)


def test_forward_asof_by_time_ranges(spark):
    r = random.Random(3)
    t = lambda: T0 + datetime.timedelta(seconds=r.randrange(100_000))
    left = [(r.choice("abc"), t(), i) for i in range(300)] + [("a", None, 300), (None, t(), 301), ("z", t(), 302)]
    right = [(k, T0 + datetime.timedelta(seconds=s), float(i)) for k in "ab" for i, s in enumerate(r.sample(range(40_000, 90_000), 40))] + [("c", T0, 1.0), ("b", t(), None)]
    prices = spark.createDataFrame(right, "k string, r_ts timestamp, price double")
    got = joins.forward_asof(spark.createDataFrame(left, "k string, ts timestamp, id long"), prices, "k", "price", rows=20)

    def want(k, ts):
        mine = sorted((a, p) for key, a, p in right if key == k and p is not None)
        return next((p for a, p in mine if ts and a >= ts), mine[-1][1] if mine else None)

    assert {x["id"]: x["price"] for x in got.collect()} == {i: want(k, ts) for k, ts, i in left}
    assert "last(__r#" in plan(got) and all("__b#" in line for line in plan(got).splitlines() if "last(__r#" in line)


def test_balanced_sorts_no_label_as_a_whole(spark):
    import hashlib

    rows = [(i, i % 10 == 0) for i in range(2000)]
    got = governance.balanced(spark.createDataFrame(rows, "event_id long, label boolean"), 4, "event_id", "label")
    key = lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)
    assert ids(got) == sorted([i for i, x in rows if x] + sorted((i for i, x in rows if not x), key=key)[:800])
    assert "row_number()" in plan(got) and all("__b#" in line for line in plan(got).splitlines() if "row_number()" in line)
