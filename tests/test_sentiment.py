"""The compound score: each rule by hand, and whole texts against a plain loop."""

import math
import random
import re

import pytest

from tidemark.operators import social

WEIGHTS = {"good": 1.9, "great": 3.1, "bad": -2.5, "awful": -2.0}
BOOSTERS, NEGATIONS = {"very": 1.0, "barely": -1.0}, ["not", "never"]


@pytest.fixture(scope="module")
def score(spark):
    weights = spark.createDataFrame([*WEIGHTS.items(), ("Good", 0.1)], "word string, weight double")

    def of(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
        got = social.compound(df, "text", weights, BOOSTERS, NEGATIONS)
        assert got.columns == ["id", "text", "compound"]
        return [r["compound"] for r in got.orderBy("id").collect()]

    return of


def norm(s):
    return round(s / math.sqrt(s * s + 15), 4)


def plain(text):
    w = [x for x in (re.sub(r"^[\W_]+|[\W_]+$", "", x) for x in re.split(r"\s+", text or "")) if x]
    loud = [x == x.upper() and x != x.lower() for x in w]
    low, s = [x.lower() for x in w], 0.0
    turn = low.index("but") if "but" in low else None
    for i, x in enumerate(low):
        v = WEIGHTS.get(x, 0.0)
        side = (v > 0) - (v < 0)
        if any(loud) and not all(loud) and loud[i]:
            v += side * 0.733
        for k, fade in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i >= k:
                v += side * fade * 0.293 * BOOSTERS.get(low[i - k], 0.0)
        if any(y in NEGATIONS or y.endswith("n't") for y in low[max(i - 3, 0) : i]):
            v *= -0.74
        if turn is not None and i != turn:
            v *= 0.5 if i < turn else 1.5
        s += v
    asked = (text or "").count("?")
    marks = min((text or "").count("!"), 4) * 0.292 + (0 if asked <= 1 else asked * 0.18 if asked <= 3 else 0.96)
    return norm(s + ((s > 0) - (s < 0)) * marks)


def test_each_rule(score):
    cases = {
        "a good day": 1.9, "a GOOD day": 1.9 + 0.733, "GOOD DAY": 1.9, "very good": 1.9 + 0.293, "very a good": 1.9 + 0.95 * 0.293, "very a b good": 1.9 + 0.9 * 0.293, "very a b c good": 1.9,
        "barely good": 1.9 - 0.293, "very bad": -2.5 - 0.293, "not good": -0.74 * 1.9, "isn't very good": -0.74 * (1.9 + 0.293), "not a b c good": 1.9, "good but bad": 0.95 - 3.75, "good!!": 1.9 + 0.584,
        "good!!!!!!": 1.9 + 1.168, "bad!": -2.5 - 0.292, "good?": 1.9, "good??": 1.9 + 0.36, "good?????": 1.9 + 0.96, "(good),": 1.9, "plain words!!": 0.0, "": 0.0, "... !": 0.0,
    }
    assert score([*cases, None]) == [*[norm(v) for v in cases.values()], 0.0]


def test_random_texts(score):
    rng = random.Random(3)
    pool = [*WEIGHTS, *BOOSTERS, *NEGATIONS, "but", "day", "can't", "The"]
    texts = [" ".join((lambda w: w.upper() if rng.random() < 0.2 else w)(rng.choice(pool)) + rng.choice(["", "", "!", "?", ","]) for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    assert score(texts) == pytest.approx([plain(t) for t in texts], abs=1.01e-4)
