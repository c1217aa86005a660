"""Figures by ranges of time, sparse correlations and the permutation test, against plain loops."""

import datetime
import math
import random

import numpy as np
import pytest

from tidemark.operators import market, origins, ranges, reports
from tidemark.sources import ledgers

T0 = datetime.datetime(2024, 1, 1)


def at(s):
    return None if s is None else T0 + datetime.timedelta(seconds=s)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    return [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *[rng.randrange(5000)] * 30]), i, rng.choice([None, *[round(rng.uniform(1, 9), 3)] * 9])) for i in range(800)]


def ordered(rows):
    keys = {}
    for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        keys.setdefault(r[0], []).append(r)
    return keys


@pytest.mark.parametrize("size", [16, 100, 1 << 16])
def test_places_and_next_values(spark, rows, size):
    df = spark.createDataFrame([(k, at(t), i, v) for k, t, i, v in rows], "key string, ts timestamp, id long, v double").repartition(6)
    got = {r["id"]: (r["__i"], r["__n"]) for r in ranges.numbered(df, "key", "ts", "id", rows=size).collect()}
    following = {r["id"]: r["after"] for r in ranges.with_next(df, "key", "ts", ["id"], "v", "after", rows=size).collect()}
    for mine in ordered(rows).values():
        for i, r in enumerate(mine):
            assert got[r[2]] == (i + 1, len(mine))
            assert following[r[2]] == (mine[i + 1][3] if i + 1 < len(mine) else None)


@pytest.mark.parametrize(("size", "share"), [(20, 0.08), (1 << 16, 2 / 7), (50, 0.9), (30, 1.0)])
def test_exponential_mean(spark, size, share):
    rng = random.Random(4)
    rows = [(k, i * 3600 + (k == "b"), rng.gauss(50, 20) if rng.random() > 0.05 else None) for k in ("a", "b") for i in range(700)]
    df = spark.createDataFrame([(k, at(t), v) for k, t, v in rows], "symbol string, ts timestamp, v double").repartition(5)
    got = {(r["symbol"], r["ts"]): r["m"] for r in ranges.decayed(df, "symbol", "ts", "v", share, "m", rows=size).collect()}
    for k in ("a", "b"):
        now = None
        for _, t, v in [r for r in rows if r[0] == k and r[2] is not None]:
            now = v if now is None else share * v + (1 - share) * now
            assert math.isclose(got.pop((k, at(t))), now, rel_tol=1e-9)
    assert not got
    assert market.ema(df.where("false"), "v", 6).count() == 0


def test_latest_keeps_whole_rows(spark, rows):
    df = spark.createDataFrame([(k, at(t), i, v) for k, t, i, v in rows], "key string, ts timestamp, id long, v double")
    got = {r["key"]: r["id"] for r in ledgers.latest(df, ["key"], "ts", "id").collect()}
    want = {k: max((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))[2] for k in ("hot", "b", None)}
    assert got == want and ledgers.latest(df, ["key"], "ts").columns == df.columns


def test_sparse_correlations_equal_dense_ones(spark):
    """Pairs with many, few and no buckets in common, and a constant origin, without a grid."""
    rng = random.Random(3)
    rows = [(o, at(3600 * h + j)) for o, p in (("a", 0.6), ("b", 0.4), ("c", 0.1)) for h in range(60) for j in range(rng.randrange(1, 4)) if rng.random() < p]
    rows += [("odd", at(3600 * h)) for h in range(70, 90, 2)] + [("even", at(3600 * h)) for h in range(71, 91, 2)] + [("all", at(3600 * h)) for h in [*range(60), *range(70, 91)]]
    df = spark.createDataFrame(rows, "origin string, ts timestamp")
    got = {(r["a"], r["b"]): r["r"] for r in origins.correlations(df, "hour").collect()}
    hours = sorted({t.replace(minute=0, second=0) for _, t in rows})
    dense = {o: [sum(1 for x, t in rows if x == o and t.replace(minute=0, second=0) == h) for h in hours] for o in {r[0] for r in rows}}
    names = sorted(dense)
    assert set(got) == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :]}
    for (a, b), r in got.items():
        want = np.corrcoef(dense[a], dense[b])[0, 1] if np.std(dense[a]) and np.std(dense[b]) else 0.0
        assert abs(r - want) < 6e-4
    assert "Cartesian" not in origins.correlations(df, "hour")._jdf.queryExecution().executedPlan().toString()


def plain(x, y, lags):
    out = []
    for lag in range(-lags, lags + 1):
        u, v = (x[: len(x) - lag], y[lag:]) if lag >= 0 else (x[-lag:], y[: len(y) + lag])
        out.append(np.corrcoef(u, v)[0, 1] if len(u) > 2 and u.std() > 0 and v.std() > 0 else 0.0)
    return np.array(out)


def test_lag_correlations():
    rng = np.random.default_rng(1)
    for x, y in ((rng.poisson(3, 40), rng.poisson(2, 40)), (rng.normal(size=25), rng.normal(size=25)), (np.ones(30), rng.poisson(3, 30)), (rng.poisson(3, 6), rng.poisson(3, 6))):
        assert np.allclose(reports.lag_correlations(x.astype(float), y.astype(float), 12), plain(x.astype(float), y.astype(float), 12)[: 25], atol=1e-9)


def test_permutations(spark):
    """A pair that follows with a lag is beaten by no shuffle, a constant one by all, and any by as many as a loop counts."""
    rng = np.random.default_rng(7)
    x = rng.poisson(4, 80).astype(float)
    follows, other = np.concatenate([rng.poisson(4, 3), x[:-3]]).astype(float), rng.poisson(4, 80).astype(float)
    rows = [("x", "follows", x.tolist(), follows.tolist()), ("x", "flat", x.tolist(), [2.0] * 80), ("x", "other", x.tolist(), other.tolist())]
    df = spark.createDataFrame(rows, "a string, b string, x array<double>, y array<double>")
    for each in (16, 7, 1000):
        got = {r["b"]: r for r in reports.permutation_test(df, 6, 59, each=each).collect()}
        assert (got["follows"]["lag"], got["follows"]["p"]) == (3, 1 / 60) and got["follows"]["r"] > 0.99
        assert (got["flat"]["lag"], got["flat"]["r"], got["flat"]["p"]) == (0, 0.0, 1.0)
        r = plain(x, other, 6)
        beaten = sum(np.abs(plain(x, np.random.default_rng([4242, i]).permutation(other), 6)).max() >= np.abs(r).max() - 1e-12 for i in range(59))
        assert got["other"]["lag"] == int(np.abs(r).argmax()) - 6 and math.isclose(got["other"]["p"], (beaten + 1) / 60)
