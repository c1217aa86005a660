"""Toxicity: words and patterns against plain Python, the label model on votes of known make, held-out accuracy, odd rows."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from small_rows import ROWS

from tidemark.llm import toxicity as T
from tidemark.llm import vectors

MARKS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())
TEXTS = ["One, two: (two) TWO... one-two?", "", "..!! ** (", "STOP IT!! now. now?? b*d w@rd é", "Été. étéx ÉTÉ", "a " * 40 + "b", None, "x. y. Z", "((((word))))"]


def bare(t):
    found = (w.strip(MARKS) for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    return {re.sub("[A-Z]", lambda m: m[0].lower(), w).encode() for w in found} - {b""}


def test_words_and_beginnings():
    w = T.Words.of(pa.array(TEXTS, pa.string()))
    known = {}
    for i, t in enumerate(TEXTS):
        alone = T.Words(pa.array([t], pa.string()))
        assert len(alone.own) == len(bare(t)) == int((w.doc == i).sum())
        known[i] = set(w.features[w.word[w.doc == i], 0].tolist())
        assert known[i] == set(alone.features[:, 0].tolist())
    for i, a in enumerate(TEXTS):
        for j, b in enumerate(TEXTS):
            assert len(known[i] & known[j]) == len(bare(a) & bare(b))
    for kind, k in enumerate(T.KINDS[1:], 1):
        assert int(w.has[:, kind].sum()) == sum(len(x) > k for x in set().union(*map(bare, TEXTS)))
    two = T.Words(pa.array(["abcdefgh abcdxyz", "abcd"], pa.string()))
    assert len({*two.features[two.has[:, 1], 1].tolist()}) == 1  # both begin with abcd; abcd itself is no longer than that


def test_patterns():
    p = T.Words.of(pa.array(TEXTS, pa.string())).patterns.tolist()
    words = [len((t or "").split()) for t in TEXTS]
    assert [x[0] for x in p] == words
    assert p[3][1:] == [2, 2, 2, 3]  # STOP, IT!!; b*d, w@rd; IT!!, now??; after "IT!!", "now." and "now??"
    assert p[1] == [0] * 5 and p[6] == [0] * 5 and p[7][4] == 1


def test_long_text_by_pieces(monkeypatch):
    rng = random.Random(2)
    t = " ".join(f"w{rng.randrange(400)}." for _ in range(3000))
    whole = T.Words(pa.array(["a b", t], pa.string()))
    monkeypatch.setattr(vectors, "pieces", lambda x, f=vectors.pieces: f(x, 500))
    cut = T.Words.of(pa.array(["a b", t], pa.string()))
    assert sorted(cut.own.tolist()) == sorted(whole.own.tolist()) and np.bincount(cut.doc).tolist() == np.bincount(whole.doc).tolist()
    assert cut.patterns[:, 0].tolist() == whole.patterns[:, 0].tolist()


def sampled(rng, n):
    """Votes of 6 voters: 0 to 3 apart from each other, 4 repeats 0 mostly, 5 says nothing."""
    y = rng.random(n) < 0.2
    hit, false = [0.9, 0.7, 0.6, 0.8, 0, 0.3], [0.05, 0.1, 0.02, 0.2, 0, 0.3]
    v = np.stack([rng.random(n) < np.where(y, a, b) for a, b in zip(hit, false, strict=True)], 1)
    v[:, 4] = np.where(rng.random(n) < 0.95, v[:, 0], rng.random(n) < 0.5)
    return y, v


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(4)
    y, v = sampled(rng, 40000)
    known = rng.random(len(y)) < 0.05
    state = np.where(known, y.astype(int), 2)
    patterns, at = np.unique(v, axis=0, return_inverse=True)
    counts = np.zeros((len(patterns), 3))
    np.add.at(counts, (at.ravel(), state), 1)
    m = T.LabelModel(patterns, counts)
    assert abs(m.prior[1] - 0.2) < 0.02
    assert np.allclose(m.rates[1, :4], [0.9, 0.7, 0.6, 0.8], atol=0.03) and np.allclose(m.rates[0, :4], [0.05, 0.1, 0.02, 0.2], atol=0.02)
    assert m.parent[4] == 0 or m.parent[0] == 4
    assert m.information[0, 4] > 20 * max(m.information[i, j] for i in range(4) for j in range(i))
    # two voters that repeat each other count little more than one
    p = m.posterior(np.array([[1, 0, 0, 0, 0, 0], [1, 0, 0, 0, 1, 0], [1, 1, 0, 0, 0, 0]], bool))
    logit = np.log(p / (1 - p))
    assert logit[2] - logit[0] > 1.5 and logit[1] - logit[0] < 0.5
    # the posterior is near the share of y among rows of a pattern
    share = np.bincount(at.ravel(), y) / np.bincount(at.ravel())
    often = np.bincount(at.ravel()) > 300
    assert np.abs(m.posterior(patterns) - share)[often].max() < 0.08


def corpus(n=700, seed=6):
    """Clean words at random; a toxic text has three of the words that begin with 'grimm', or the word 'vileword'."""
    rng = random.Random(seed)
    clean = [f"{a}{b}{c}" for a in ("ta", "ro", "li", "mo") for b in ("na", "ke", "su") for c in ("n", "ra", "to", "l")]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randrange(5, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for x in [f"grimm{rng.choice(clean)}" for _ in range(3)] if rng.random() < 0.6 else ["vileword"]:
                w.insert(rng.randrange(len(w)), x)
        elif rng.random() < 0.1:
            w.insert(0, f"grimm{rng.choice(clean)}")
        rows.append((i, " ".join(w), "en", "a"))
        if rng.random() < 0.7:
            labels.append((i, int(toxic)))
        rows[-1] += (toxic,)
    return rows, labels


def test_held_out_texts_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(20000 + (r[0] or 0) if r[0] else None, *r[1:], False) for r in ROWS]
    df = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string, source string, toxic boolean").withColumns({c: F.lit("x") for c in ("id", "y", "votes", "draw", "score", "label")})
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 7), *labels[:5]], "doc_id long, toxic int")
    got = T.scores(df.drop("toxic").repartition(3), marks)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == len(rows) + len(odd)
    truth = {r[0]: r[4] for r in rows}
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and np.mean([bool(r["predicted"]) == truth[r["doc_id"]] for r in held]) > 0.97
    assert not any(r["predicted"] for r in found if r["doc_id"] not in truth)
    again = {(r["doc_id"], round(r["score"], 9)) for r in T.scores(df.drop("toxic").repartition(7), marks).collect()}
    assert again == {(r["doc_id"], round(r["score"], 9)) for r in found}
    # labels of held-out rows are no input
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels], "doc_id long, toxic int")
    same = {(r["doc_id"], round(r["score"], 9)) for r in T.scores(df, flipped).collect()}
    assert same == {(r["doc_id"], round(r["score"], 9)) for r in T.scores(df, marks.where("doc_id is not null and toxic in (0, 1)").distinct()).collect()}


@pytest.mark.parametrize("labels", [[], [(4, 0), (6, 0)]])
def test_without_a_label_of_one(spark, docs, none, labels):
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = T.scores(docs, marks).collect()
    assert len(found) == len(ROWS) and all(r["score"] == 0 and r["predicted"] == 0 for r in found)
    assert T.scores(none, marks).count() == 0
