"""The n-gram join on texts made of common passages: no link is lost, and few pairs are counted."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import ngram_join, vectors


def mixtures(n, seed, passages=40, of=10, near=0):
    """Texts of some of the passages in order; of each of the first `near` a second text with one more passage, and a third one with two."""
    rnd = random.Random(seed)
    parts = [" ".join(f"p{p}w{i}" for i in range(30)) for p in range(passages)]
    chosen = [rnd.sample(range(passages), of) for _ in range(n)]
    for c in chosen[:near]:
        rest = [p for p in range(passages) if p not in c]
        chosen += [c + rnd.sample(rest, 1), c + rnd.sample(rest, 2)]
    return [(i, " ".join(parts[p] for p in sorted(c))) for i, c in enumerate(chosen)]


def components(rows):
    """(doc_id, smallest id that links reach), all pairs compared."""
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    to = list(range(len(rows)))

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                to[y] = x
    return [(i, root(i)) for i, _ in rows]


@pytest.fixture
def counted(monkeypatch):
    """How many pairs had their overlaps counted, in each call."""
    seen, verified = [], ngram_join._verified

    def count(pairs, parts):
        seen.append(pairs.count())
        return verified(pairs, parts)

    monkeypatch.setattr(ngram_join, "_verified", count)
    return seen


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted((r["doc_id"], r["component_id"]) for r in ngram_join.classes(df).collect())


@pytest.mark.parametrize(("passages", "of"), [(14, 10), (8, 3)])
def test_mixtures_lose_no_link(spark, passages, of):
    rows = mixtures(120, passages, passages, of, near=20)
    expected = components(rows)
    assert len({c for _, c in expected}) < len(rows)
    assert found(spark, rows) == expected


def test_few_pairs_of_mixtures_are_counted(spark, counted):
    for size in (150, 600):
        rows = mixtures(size, 1, near=size // 20)
        assert found(spark, rows) == components(rows)
        assert sum(counted) <= size // 4
        counted.clear()


def test_parities_bound_overlaps():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        pool = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (np.unique(rnd.choice(pool, rnd.integers(1, 400), replace=False)) for _ in range(2))
        x, y = ngram_join._parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        m = min(len(x), len(y))
        odd = np.bitwise_xor.reduce(x.reshape(-1, m)) ^ np.bitwise_xor.reduce(y.reshape(-1, m))
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - np.unpackbits(odd.view(np.uint8)).sum()) / 2
    assert ngram_join._parities(np.zeros(0, np.uint64), np.zeros(1, np.int64)) == []


def test_releasing_changes_no_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a", None, ""]})
    twice = vectors.releasing(lambda batches: (b for b in batches for _ in range(2)))
    assert [b.to_pydict() for b in twice([batch, batch])] == [batch.to_pydict()] * 4
    assert list(twice([])) == []
    table = pa.table({"k": [1, 2]})
    assert vectors.releasing_group(lambda t: t.slice(1))(table).to_pydict() == {"k": [2]}
