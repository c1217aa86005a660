"""Language of each word and text by a linear-chain conditional random field.

A word's features are its hash (lexicon), its first and last one to three bytes (affixes) and all its byte 2-, 3- and
4-grams, each hashed to a row of weights with a column a language; a learned matrix scores each step from one word's
language to the next's. Forward-backward gives every word its probability of each language, so a text may switch
between languages; the text's language is the one with the largest sum.

Bounds of one chain, not of the text: a word of more than LONGEST bytes (scripts without spaces, glued runs) stands
for several words of that size, and a text of more than CHAIN of them for several chains. All of them count.

Training uses a sample of labelled rows: of each label about TRAIN_ROWS / labels rows, or fewer so that all labels
together have about TRAIN_CHARS characters, chosen by hashes of id and text and sorted by them, so the same rows in the
same order on every run and in any partitions. Long texts are as likely as short ones. Their words are spliced into
sequences that change language, so that the steps are learned from switched text. Every row is predicted from its
whole text.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; a label of null is not learned from;
without any label every text is ``und``; ties go to the first language in order; repeated rows are predicted one by
one; an empty table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage, vectors

TRAIN_ROWS, TRAIN_CHARS = 4000, 24_000_000
#: Bytes of a word, and words of a chain.
LONGEST, CHAIN = 64, 4096
ROWS = 1 << 18
EPOCHS, RATE = 2, 0.3
SPLICE = 40
FOLDS, HELD_OUT = 5, 0
U = np.uint64


def _vocabulary(texts: pa.Array):
    """(place in the batch's list of distinct words of each word, first word of each text, features of each distinct word, where they begin)."""
    hashes, first, data, starts, ends = vectors.words(texts, lower=True)
    if len(starts) and (ends - starts).max() > LONGEST:
        parts = -(-(ends - starts) // LONGEST)
        first = np.concatenate([[0], np.cumsum(parts)])[first]
        ends = np.repeat(ends, parts)
        starts = np.repeat(starts, parts) + vectors.ranges(np.zeros(len(parts), np.int64), parts) * LONGEST
        ends = np.minimum(ends, starts + LONGEST)
        hashes = vectors.hashed(data, starts, ends)
    _, index, words = np.unique(hashes, return_index=True, return_inverse=True)
    rows, at = _features(data, starts[index], ends[index], hashes[index])
    return words, first, rows, at


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = ends - starts
    sets, owner = [vectors.mix(hashes ^ U(11))], [np.arange(len(n))]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for k in (1, 2, 3):  # affixes
        long = np.flatnonzero(n >= k)
        for kind, begin in ((0, starts[long]), (1, ends[long] - k)):
            code = np.zeros(len(long), U)
            for j in range(k):
                code = code * U(257) + padded[begin + j].astype(U) + U(1)
            sets.append(vectors.mix(code * U(64) + U(8 * kind + k)))
            owner.append(long)
    for k in (2, 3, 4):
        m = np.maximum(n - k + 1, 0)
        begin = vectors.ranges(starts, m)
        code = np.zeros(len(begin), U)
        for j in range(k):
            code = code * U(257) + padded[begin + j].astype(U) + U(1)
        sets.append(vectors.mix(code * U(64) + U(32 + k)))
        owner.append(np.repeat(np.arange(len(n)), m))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(sets)[order] & U(ROWS - 1)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(n) + 1))


def _emissions(weights: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of each distinct word: the mean of its features' weights, so that long words do not outweigh short ones."""
    if len(at) < 2:
        return np.zeros((0, weights.shape[1]), np.float32)
    sums = np.add.reduceat(weights[rows], at[:-1])
    return sums / np.sqrt(np.diff(at))[:, None].astype(np.float32)


def forward_backward(scores: np.ndarray, steps: np.ndarray, lengths: np.ndarray, pairs: bool = False):
    """Probabilities of each language at each word of each sequence; scores (words, languages) lie one sequence after another.

    Sequences run side by side, longest first, so that one array operation moves all that still have words by one.
    With pairs, also the sum over words of the probabilities of each step.
    """
    k, order = scores.shape[1], np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    top = int(lengths[0]) if len(lengths) else 0
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(top), "right")
    e = np.exp(scores - scores.max(1, keepdims=True, initial=-1e30)) + 1e-30
    move = np.exp(steps - steps.max())
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = None
    for t in range(top):
        at = begin[: alive[t]] + t
        a = e[at] if t == 0 else (a[: alive[t]] @ move) * e[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    b = np.ones((len(lengths), k), e.dtype)
    total = np.zeros((k, k))
    for t in range(top - 1, -1, -1):
        at = begin[: alive[t]] + t
        more = alive[t + 1] if t + 1 < top else 0
        cur = np.ones((alive[t], k), e.dtype)
        if more:
            right = b[:more] * e[at[:more] + 1]
            cur[:more] = right @ move.T
            if pairs:
                left = alpha[at[:more]]
                z = np.einsum("ni,ij,nj->n", left, move, right)
                total += np.einsum("ni,ij,nj->ij", left / z[:, None], move, right)
            cur /= cur.sum(1, keepdims=True)
        beta[at] = cur
        b = cur
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    return (p, total) if pairs else p


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, steps: np.ndarray):
        self.languages, self.weights, self.steps = languages, weights, steps


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """AdaGrad on the log-likelihood of spliced sequences."""
    languages = sorted(set(labels))
    k, rng = len(languages), np.random.default_rng(seed)
    weights, squares = np.zeros((ROWS, k), np.float32), np.full(ROWS, 1e-2, np.float32)
    steps, step_squares = np.zeros((k, k)), np.full((k, k), 1.0)
    cut, owner = vectors.pieces(pa.array(texts, pa.string()))
    texts, code = cut.to_pylist(), np.array([languages.index(x) for x in labels])[owner]
    sizes = np.array([len(x) for x in texts])
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        # batches of 64 texts, or of fewer long ones
        batch = np.maximum(np.cumsum(sizes[order]) // (1 << 20), np.arange(len(order)) // 64)
        for mine in np.split(order, np.flatnonzero(np.diff(batch)) + 1):
            words, first, rows, at = _vocabulary(pa.array([texts[j] for j in mine], pa.string()))
            y = np.repeat(code[mine], np.diff(first))
            if not len(y):
                continue
            # splice: texts are cut every SPLICE words, and the pieces dealt out anew for half of them
            piece = np.concatenate([np.arange(a, b, SPLICE) for a, b in zip(first[:-1], first[1:], strict=True)])
            ends = np.append(piece[1:], len(y))
            mixed = rng.permutation(len(piece))
            half = len(piece) // 2
            take = np.concatenate([np.arange(piece[p], ends[p]) for p in mixed])
            run = (ends - piece)[mixed]
            groups = np.concatenate([np.add.reduceat(run[:half], np.arange(0, half, 4)) if half else run[:0], run[half:]])
            words, y = words[take], y[take]
            p, pairs = forward_backward(_emissions(weights, rows, at)[words].astype(float), steps, groups, pairs=True)
            inside = np.ones(len(y), bool)
            inside[np.cumsum(groups) - 1] = False
            seen = np.bincount(y[:-1][inside[:-1]] * k + y[1:][inside[:-1]], minlength=k * k).reshape(k, k)
            rate = RATE / (1 + epoch)
            g = pairs - seen
            g /= max(1, len(groups))
            step_squares += g * g
            steps -= rate * g / np.sqrt(step_squares)
            p[np.arange(len(y)), y] -= 1
            order_w = np.argsort(words, kind="stable")
            new = np.searchsorted(words[order_w], np.arange(len(at) - 1))
            per_word = np.add.reduceat(p[order_w], new) / np.sqrt(np.diff(at))[:, None]
            f_order = np.argsort(rows, kind="stable")
            ids = rows[f_order]
            start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            g = np.add.reduceat(per_word[np.repeat(np.arange(len(at) - 1), np.diff(at))[f_order]], start).astype(np.float32)
            squares[ids[start]] += (g * g).sum(1)
            weights[ids[start]] -= rate * g / np.sqrt(squares[ids[start]])[:, None]
    return Model(languages, weights, steps)


def word_languages(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of each word's language, first word of each text)."""
    words, first, rows, at = _vocabulary(texts)
    if not len(words):
        return np.zeros((0, len(model.languages))), first
    chains = np.unique(np.concatenate([first, *[np.arange(a, b, CHAIN) for a, b in zip(first[:-1], first[1:], strict=True) if b - a > CHAIN]]))
    return forward_backward(_emissions(model.weights, rows, at)[words], model.steps.astype(np.float32), np.diff(chains)), first


def _predict(model):
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in vectors.slices(batches):
            total, n = np.zeros((b.num_rows, len(m.languages))), np.zeros(b.num_rows, np.int64)
            texts, owner = vectors.pieces(b.column("text"))
            step = b.num_rows if len(texts) == b.num_rows else 1  # pieces of a long text go one at a time
            for i in range(0, len(texts), step):
                p, first = word_languages(m, texts.slice(i, step))
                sums = np.concatenate([np.zeros((1, len(m.languages))), np.cumsum(p, 0, dtype=float)])
                np.add.at(total, owner[i : i + step], sums[first[1:]] - sums[first[:-1]])
                np.add.at(n, owner[i : i + step], np.diff(first))
            best = total.argmax(1)
            score = np.clip(total[np.arange(len(best)), best] / np.maximum(n, 1), 0, 1)
            letters = b.column("letters").to_numpy(zero_copy_only=False)
            names = [m.languages[i] if ok else "und" for i, ok in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))], names=["id", "held_out", "lang_pred", "score"])

    return predict


def held_out(key: str, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % folds == fold, F.lit(False))


def predictions(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", held: Column | None = None) -> DataFrame:
    """key, held_out, lang_pred, score of each row; rows that are not held out and have a label may be learned from."""
    spark = df.sparkSession
    storage.ship(spark)
    held = held_out(key) if held is None else held
    every = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").cast("string").alias("label"), held.alias("held_out"))
    every = every.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    labelled = every.where(F.col("label").isNotNull() & ~F.col("held_out") & F.col("letters"))
    shares = labelled.groupBy("label").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))
    shares = shares.collect()
    of = [(r["label"], int(min(1.0, TRAIN_ROWS / len(shares) / r["rows"], TRAIN_CHARS / len(shares) / r["chars"]) * (1 << 31))) for r in shares]
    shares = spark.createDataFrame(of, "label string, most long")
    # about as many rows as wanted, the same ones on every run; of rows alike in id and text not more than the bound
    drawn = labelled.join(storage.small(shares, len(of), 64), "label").withColumn("draw", F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 31) - 1))).where("draw < most")
    sample = drawn.select("draw", "id", "text", "label").orderBy("draw", "id", "text", "label").limit(2 * TRAIN_ROWS).collect()
    if not sample:
        return every.select(F.col("id").alias(key), "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = spark.sparkContext.broadcast(train([r["text"] for r in sample], [r["label"] for r in sample]))
    kind = every.schema["id"].dataType.simpleString()
    found = every.select("id", "text", "held_out", "letters").mapInArrow(_predict(model), f"id {kind}, held_out boolean, lang_pred string, score double")
    return found.withColumnRenamed("id", key)
