"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade >= j) = sigmoid(s - t_j) with one score s = w . x for all grades and ordered thresholds t_1 < t_2 < ... The
features x are each distinct word of a text, its first four, five and six bytes and its last two, hashed to ROWS
weights and divided by the root of the number of distinct words. The expected grade ranks texts; the tail
probability P(grade >= select) decides which are taken.

Training uses a sample of about TRAIN_ROWS ratings, chosen by hashes of id and grade, or fewer of them so that their
texts have about TRAIN_CHARS characters together; long texts are as likely as short ones, and all texts are scored in
full. Defined cases: a null text has no words, so its score is the bias alone; a null rating, or one outside 0 ..
levels - 1, is not learned from; a grade that an id has more than once counts once; rows alike in id and text count
once in training and are scored one by one; without ratings every row has null results and is not selected; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, vectors

TRAIN_ROWS, TRAIN_CHARS = 8000, 48_000_000
ROWS = 1 << 18
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.4, 0.02
GRADES, SELECT = 3, 2
U = np.uint64


def _text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature rows of each distinct word of the batch, distinct words of each text, where each text's begin)."""
    hashes, first, data, starts, ends = vectors.words(texts, lower=True)
    _, index, words = np.unique(hashes, return_index=True, return_inverse=True)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs = vectors.distinct((doc.astype(U) << U(32)) | words.astype(U))
    at = np.searchsorted(pairs, np.arange(len(first), dtype=U) << U(32))
    starts, ends, own = starts[index], ends[index], hashes[index]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    rows = [vectors.mix(own ^ U(21))]
    for kind, k in ((1, 4), (2, 5), (3, 6), (4, 2)):
        begin = starts if kind < 4 else np.maximum(ends - k, starts)
        code = np.full(len(starts), kind, U)
        for j in range(k):
            code = code * U(257) + np.where(begin + j < ends, padded[begin + j], 0).astype(U) + U(1)
        rows.append(vectors.mix(code))
    return (np.stack(rows, 1) & U(ROWS - 1)).astype(np.int64), (pairs & U(0xFFFFFFFF)).astype(np.int64), at


class Model:
    def __init__(self, weights: np.ndarray, bias: float, thresholds: np.ndarray):
        self.weights, self.bias, self.thresholds = weights, bias, thresholds

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... of each text."""
        rows, words, at = _text_words(texts)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[rows].sum(1)[words], dtype=float)])
        s = self.bias + (sums[at[1:]] - sums[at[:-1]]) / np.sqrt(np.maximum(np.diff(at), 1))
        return 1 / (1 + np.exp(np.clip(self.thresholds - s[:, None], -40, 40)))


def losses(s: np.ndarray, grade: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(negative log-likelihood, its derivative by each score, by each text's thresholds) of grades at scores s."""
    tail = 1 / (1 + np.exp(np.clip(thresholds - s[:, None], -40, 40)))
    padded = np.concatenate([np.ones((len(s), 1)), tail, np.zeros((len(s), 1))], 1)
    slope = np.concatenate([np.zeros((len(s), 1)), tail * (1 - tail), np.zeros((len(s), 1))], 1)
    i = np.arange(len(s))
    p = np.maximum(padded[i, grade] - padded[i, grade + 1], 1e-9)
    by_t = np.zeros_like(tail)
    for j in range(tail.shape[1]):  # t_j lowers tail j
        by_t[:, j] = np.where(grade == j + 1, slope[:, j + 1], np.where(grade == j, -slope[:, j + 1], 0)) / p
    return -np.log(p).sum(), -(slope[i, grade] - slope[i, grade + 1]) / p, by_t


def train(texts: list[str | None], grades: list[int], levels: int = GRADES, seed: int = 5) -> Model:
    """AdaGrad on the log-likelihood with weight decay; thresholds keep their order as a first one plus positive steps."""
    rng, y = np.random.default_rng(seed), np.asarray(grades)
    weights, squares = np.zeros(ROWS, np.float32), np.full(ROWS, 1e-3, np.float32)
    # thresholds begin where a text without evidence has the ratings' own distribution
    below = np.clip(np.cumsum(np.bincount(y, minlength=levels))[:-1] / len(y), 1e-3, 1 - 1e-3)
    prior = np.log(below / (1 - below))
    first, gaps, gap_squares = prior[0], np.log(np.maximum(np.diff(prior), 1e-2)), np.ones(levels - 2)
    bias, bias_square = 0.0, 1.0
    batches = []
    order = rng.permutation(len(texts))
    for i in range(0, len(order), BATCH):
        mine = order[i : i + BATCH]
        rows, words, at = _text_words(pa.array([texts[j] for j in mine], pa.string()))
        batches.append((y[mine], rows.astype(np.int32), words.astype(np.int32), at))
    for epoch in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            grade, rows, words, at = batches[b]
            n = np.sqrt(np.maximum(np.diff(at), 1))
            sums = np.concatenate([[0.0], np.cumsum(weights[rows].sum(1)[words], dtype=float)])
            s = bias + (sums[at[1:]] - sums[at[:-1]]) / n
            steps = np.exp(gaps)
            t = first + np.concatenate([[0.0], np.cumsum(steps)])
            _, g, by_t = losses(s, grade, t)
            rate = RATE / (1 + epoch) ** 0.5
            gap_g = np.array([by_t[:, j + 1 :].sum() * steps[j] for j in range(levels - 2)])
            gap_squares += gap_g**2
            gaps -= rate * gap_g / np.sqrt(gap_squares)
            bias_square += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(bias_square)
            per_word = np.bincount(words, np.repeat(g / n, np.diff(at)), minlength=len(rows))
            flat, spread = rows.ravel(), np.repeat(per_word, rows.shape[1])
            ids, back = np.unique(flat, return_inverse=True)
            gw = (np.bincount(back, spread) + DECAY * weights[ids]).astype(np.float32)
            squares[ids] += gw * gw
            weights[ids] -= rate * gw / np.sqrt(squares[ids])
    return Model(weights, float(bias), first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def _score(model, select: int):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in vectors.slices(batches):
            tails = m.tails(b.column("text"))
            tail = tails[:, select - 1]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(tails.sum(1)), pa.array(tail), pa.array(tail >= 0.5)], names=["id", "expected_grade", "tail_probability", "selected"])

    return score


def selection(df: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", rated: str = "doc_id", grade: str = "grade", select: int = SELECT, levels: int = GRADES) -> DataFrame:
    """key, expected_grade, tail_probability, selected of each row of df; ratings holds ids and grades 0 .. levels - 1."""
    spark = df.sparkSession
    storage.ship(spark)
    every = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    known = ratings.select(F.col(f"`{rated}`").alias("id"), F.col(f"`{grade}`").cast("int").alias("grade")).dropna().where(f"grade between 0 and {levels - 1}").distinct()
    share = int(min(1.0, TRAIN_ROWS / max(known.count(), 1)) * (1 << 31))
    chosen = storage.materialise(known.where(F.xxhash64("id", "grade").bitwiseAND(F.lit((1 << 31) - 1)) < share), "ratings")
    drawn = every.join(storage.small(chosen, chosen.count(), 24), "id").withColumn("draw", F.xxhash64("grade", "id", "text").bitwiseAND(F.lit((1 << 31) - 1)))
    drawn = storage.materialise(drawn.select("id", "text", "grade", "draw").distinct(), "rated")
    rows, chars = drawn.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    share = int(min(1.0, 1.5 * TRAIN_ROWS / max(rows, 1), TRAIN_CHARS / max(chars, 1)) * (1 << 31))
    sample = drawn.where(f"draw < {share}").select("id", "text", "grade").collect()
    if not sample:
        return every.select(F.col("id").alias(key), F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(False).alias("selected"))
    sample.sort(key=lambda r: (r["id"], r["grade"], r["text"] or ""))
    model = spark.sparkContext.broadcast(train([r["text"] for r in sample], [r["grade"] for r in sample], levels))
    kind = every.schema["id"].dataType.simpleString()
    found = every.mapInArrow(_score(model, select), f"id {kind}, expected_grade double, tail_probability double, selected boolean")
    return found.withColumnRenamed("id", key)
