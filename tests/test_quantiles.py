"""Exact quantiles against numpy, and chains and matches against plain walks."""

import datetime
import random

import numpy as np
import pytest

from tidemark.operators import quality, quantiles

T0 = datetime.datetime(2024, 1, 1)


def expected(values, q, rank):
    v = sorted(values)
    at = q * (len(v) - 1)
    if rank == "linear":
        return float(np.quantile(v, q))
    return v[round(at) if rank == "even" else int(at)]


@pytest.mark.parametrize("rank", ["linear", "floor", "even"])
@pytest.mark.parametrize(("ranges", "few"), [(1024, 4096), (3, 2), (7, 10)])
def test_exact(spark, rank, ranges, few):
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 1)) for _ in range(300)] + [("b", float(rng.randrange(4))) for _ in range(200)] + [("hot", 1.5)] * 500 + [("hot", 1e300), ("hot", -1e300)]
    rows += [(None, 10.0**k) for k in range(-150, 150, 7)] + [("one", 2.0), ("nan", float("nan")), ("nan", 3.0), ("none", None), ("wide", 1.7e308), ("wide", -1.7e308), ("wide", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    wanted = {"low": 0.0, "third": 1 / 3, "median": 0.5, "p90": 0.9, "top": 1.0}
    got = {r["k"]: r for r in quantiles.exact(df, ["k"], "v", wanted, rank, ranges, few).collect()}
    values = {}
    for k, v in rows:
        if v is not None and v == v:
            values.setdefault(k, []).append(v)
    assert set(got) == set(values)
    for k, v in values.items():
        for name, q in wanted.items():
            assert np.isclose(got[k][name], expected(v, q, rank), rtol=1e-12, atol=0), (k, name)


def test_without_keys_and_empty(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "v double")
    assert [tuple(r) for r in quantiles.exact(df, [], "v", {"m": 0.25}).collect()] == [(2.5,)]
    assert quantiles.exact(df.where("false"), [], "v", {"m": 0.25}).count() <= 1
    assert quality.score_distribution(spark.createDataFrame([], "k string, score double"), ["k"]).count() == 0


def seconds(t):
    return T0 + datetime.timedelta(seconds=t)


def by_trigger(labels, decisions, width, by_label):
    out, used = set(), set()
    mine, others = (labels, decisions) if by_label else (decisions, labels)
    others = sorted((t, i) for _, t, i in others)
    for _, t, i in sorted(mine, key=lambda r: (r[1], r[2])):
        below = [j for j, o in enumerate(others) if o[0] < t]
        at = len(below)
        if by_label:
            near = [j for j in (at - 1, at) if 0 <= j < len(others) and j not in used]
        else:
            free = [j for j in range(len(others)) if j not in used]
            near = [x for x in (max((j for j in free if j < at), default=None), min((j for j in free if j >= at), default=None)) if x is not None]
        near = [j for j in near if abs(others[j][0] - t) <= width]
        if near:
            j = min(near, key=lambda j: (abs(others[j][0] - t), j))
            used.add(j)
            out.add((i, others[j][1]) if by_label else (others[j][1], i))
    return out


@pytest.mark.parametrize("rows", [1, 50, 4096])
def test_greedy_matches(spark, monkeypatch, rows):
    """Chains of many lengths, in groups of whole chains, against one walk over each origin."""
    monkeypatch.setattr(quality._grouped, "__defaults__", (rows,))
    rng = random.Random(5)
    sides = [[(o, rng.randrange(40_000 if o == "gaps" else 4000), 1000 * s + i) for i in range(150) for o in ("gaps", "dense")] for s in (1, 2)]
    sides = [[(o, t, i * 2 + (o == "dense")) for o, t, i in x] for x in sides]
    labels, decisions = (spark.createDataFrame([(o, seconds(t), i) for o, t, i in x], "origin string, ts timestamp, event_id long").repartition(3) for x in sides)
    for f, flag in ((quality.greedy_by_trigger, False), (quality.greedy_by_label, True)):
        got = {(r["label_id"], r["decision_id"]) for r in f(labels, decisions, 120).collect()}
        assert got == set().union(*[by_trigger([r for r in sides[0] if r[0] == o], [r for r in sides[1] if r[0] == o], 120, flag) for o in ("gaps", "dense")])


def test_free_places():
    rng, free, taken = random.Random(1), quality._Free(60), set()
    for i in rng.sample(range(60), 60):
        free.take(i)
        taken.add(i)
        for j in range(61):
            assert free.at_least(j) == min((x for x in range(j, 60) if x not in taken), default=None)
            assert free.below(j) == max((x for x in range(j) if x not in taken), default=None)
