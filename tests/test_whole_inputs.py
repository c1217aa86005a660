"""Queries that take every row of their inputs, against loops over them."""

import bisect
import datetime
import json
import random

import pytest

from tidemark.operators import reports
from tidemark.plans import registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with a small events table of two symbols, and its rows."""
    r, t0 = random.Random(5), datetime.datetime(2024, 1, 1)
    times = r.sample(range(400_000), 240)
    rows = [(i, t0 + datetime.timedelta(seconds=t), i % 9, r.choice(["view", "click"]), r.choice([0.0, 5.0, 40.0, 150.0, 400.0]), json.dumps({"k": r.randrange(100)})) for i, t in enumerate(times)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d, rows


def book(rows):
    out = {}
    for x in sorted(rows, key=lambda x: x[1]):
        times, prices = out.setdefault(x[3], ([], []))
        times.append(x[1])
        prices.append(100 + x[4])
    return out


def price(out, symbol, ts):
    times, prices = out[symbol]
    return prices[min(bisect.bisect_left(times, ts), len(times) - 1)]


def test_every_signal_is_traded_and_compounded(spark, tables):
    d, rows = tables
    ticks, want, equity = book(rows), {}, {}
    for i, ts, _, symbol, *_ in sorted(rows, key=lambda x: (x[1], x[0])):
        side, entry = -1 if i % 3 == 0 else 1, price(ticks, symbol, ts)
        moves = [side * (price(ticks, symbol, ts + datetime.timedelta(minutes=12 * j)) / entry - 1) for j in range(11)]
        pnl = round(next((m for m in moves if m <= -0.2), moves[-1]) - 0.001, 6)
        equity[symbol] = equity.get(symbol, 1.0) * (1 + pnl)
        want[i] = (pnl, any(m <= -0.2 for m in moves), equity[symbol])
    got = {x["event_id"]: x for x in registry.QUERIES["paper_trades_equity"](spark, d).collect()}
    assert len(got) == len(rows) and min(x[0] for x in want.values()) < -1
    for i, (pnl, stopped, e) in want.items():
        assert got[i]["pnl_pct"] == pytest.approx(pnl, abs=2e-6) and got[i]["stopped"] == stopped and got[i]["equity"] == pytest.approx(e, rel=1e-3, abs=2e-6)


def test_equity_by_ranges_with_zeros_and_signs(spark):
    t0 = datetime.datetime(2024, 1, 1)
    pnl = {"a": [0.5, -1.5, 0.25, -3.0, 0.1, -0.5] * 4, "b": [0.1, -1.0, 0.2]}
    rows = [(s, t0 + datetime.timedelta(hours=i), i, p) for s, all_ in pnl.items() for i, p in enumerate(all_)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, event_id long, pnl_pct double")
    for n in (3, 1000):
        got = {(x["symbol"], x["event_id"]): x["equity"] for x in reports.paper_equity(df, ["ts", "event_id"], rows=n).collect()}
        for s, all_ in pnl.items():
            e = 1.0
            for i, p in enumerate(all_):
                e *= 1 + p
                assert got[s, i] == pytest.approx(e, abs=2e-6)


def test_every_event_is_looked_up(spark, tables):
    d, rows = tables
    ticks = book(rows)
    got = {x["event_id"]: x["price"] for x in registry.QUERIES["forward_price_lookup_all"](spark, d).collect()}
    assert got == {x[0]: price(ticks, x[3], x[1]) for x in rows}
