"""Hard negatives: the tree's bounds, and every result against brute force on odd rows, in deep trees and small blocks, and the SQL."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as H
from tidemark.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    ok = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for a, (i, v, label) in enumerate(ok):
        if i % 50:
            continue
        s = [(-sum(x * y for x, y in zip(v, w, strict=False)), j, m) for b, (j, w, m) in enumerate(ok) if b != a]
        for p, j, _ in sorted(x for x in s if x[2] == label)[:positives]:
            inside = sorted(x for x in s if x[2] != label and low * -p <= 100 * -x[0] <= high * -p)
            out += [(i, j, r + 1, k, -p, -t) for r, (t, k, _) in enumerate(inside[:negatives])]
    return sorted(out)


def odd_rows(n=420, width=6, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)], rng.randrange(4)) for i in range(n)]
    same = [0.5] * width
    rows += [(1000 + i, same, i % 3) for i in range(80)]  # copies: ties, and a leaf of many blocks
    rows += [(50, [0.1] * width, 1), (50, [0.1] * width, 1), (100, None, 1), (150, [0.2] * width, None), (None, [0.3] * width, 1), (200, [0.1, None, 0.2, 0.1, 0.1, 0.1], 2), (250, [float("nan")] + [0.1] * (width - 1), 2)]
    rows += [(300, [float("inf")] + [0.1] * (width - 1), 2), (350, [0.4, 0.3], 2), (400, [], 1), (450, [0.0] * width, 0), (500, [-0.5] * width, 77)]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("other") for c in ("id", "k", "v", "anchor", "leaf", "block", "score", "w")}).repartition(3)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("sample", "leaf", "block"), [(H.SAMPLE, H.LEAF, H.BLOCK), (100, 8, 16), (10**6, 40, 10**6)])
def test_against_brute_force(spark, sample, leaf, block):
    rows = odd_rows()
    assert got(H.mined(table(spark, rows), F.col("vec_id") % 50 == 0, sample=sample, leaf=leaf, block=block)) == brute(rows)


def test_other_windows_and_large_components(spark):
    rows = [(i, [x * 3e5 for x in v] if v else v, m) for i, v, m in odd_rows(160, seed=2) if v and all(x is not None and math.isfinite(x) for x in v)]
    assert got(H.mined(table(spark, rows), F.col("vec_id") % 50 == 0, positives=2, negatives=4, low=20, high=101, leaf=16)) == brute(rows, 2, 4, 20, 101)


def test_empty_and_without_anchors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert H.mined(none, F.col("vec_id") % 50 == 0).count() == 0
    assert H.mined(spark.createDataFrame([(1, [0.1], 1), (2, [0.2], 2)], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    assert H.mined(spark.createDataFrame([(50, [0.1], 1), (100, None, 2)], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_bounds():
    """No row's score leaves the bounds of its leaf, and near leaves are told from far ones."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([rng.normal(c, 0.05, (300, 8)) for c in (-1, 0, 1)])).astype(np.int64)
    most = float((x.astype(float) ** 2).sum(1).max())
    tree = H.Tree(x[::3], most, 4)
    leaf, ways = tree.place(x)
    leaves = np.unique(leaf)
    low, high = (np.array([f(ways[leaf == i], 0) for i in leaves]) for f in (np.min, np.max))
    least, top = tree.scores(x, leaves, low, high)
    scores = x @ x.T
    for j, i in enumerate(leaves):
        own = scores[:, leaf == i]
        assert (own >= least[:, [j]]).all() and (own <= top[:, [j]]).all()
    best = scores.max(1)
    assert (top < best[:, None]).mean() > 0.3


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no tables here")
def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cur = c.execute(queries.OP13)
    df = queries.op13_hard_negatives(spark, sf)
    assert df.columns == [x[0] for x in cur.description]
    found = cur.fetchall()
    assert found and sorted(map(tuple, df.collect())) == sorted(found)
