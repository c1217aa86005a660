"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

A word is reached through classes: log P(word | text before) is a sum over the nodes on its way, each a softmax over
WIDTH outputs with hashed features of the text before.

* The root chooses among clusters of frequent words and tails of all others. A cluster chooses among groups of its
  words of about equal counts, a group again among such groups; the commonest words are groups by themselves. In a
  last group, and in a tail, a word has its share of the training counts.
* Features are the word before, the two words before (at the root) and the word before that one alone (a skip), each
  hashed with the node to a row of weights with a column an output. Biases are the logarithms of training counts, so
  that without weights the model is the distribution of counts.
* Weights are trained by distributed gradient updates: every task takes AdaGrad steps over all tokens of its texts
  from the common weights, and rows are averaged by how often each task has met them. Which texts share a task
  decides the order of steps, so scores differ a little between partitionings.
* Clusters come from k-means over the frequent words around each head word. A tail is told by a word's last two
  bytes, which its hash carries, so any word has one, known or not.

Bounds: about HEAD words with a way of their own (all whose count is above a threshold, never a part of those of a
count), and ROWS rows of weights at most (fewer for small corpora, one for each
SHARE tokens), as every task holds them; the counts of TABLE words are broadcast, those of all others joined, with the
same result. No token is dropped: counts, gradients and scores cover all texts. Defined cases: a null text is an empty
one and holds the end token only; a null id is never held out; a corpus without training texts scores all words as
unknown, by their tails alone; repeated rows are learned and scored as often as they occur; other columns of the input
are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage, vectors

HEAD, TABLE, ROWS, SHARE = 1 << 15, 1 << 19, 1 << 17, 4
WIDTH, CLUSTERS, TAILS, SEEDS = 32, 26, 6, 64
BATCH, RATE = 8192, 0.6
#: Tokens that a task of a training round takes at least, where there are that many; parts that are summed at first.
TASK_TOKENS, PARTS = 4_000_000, 16
BLOCKS = 64
FOLDS, HELD_OUT = 5, 1
#: Bias of an output without words: it gets no probability.
EMPTY = -1e9
#: Rows that a batch meets so often at most are added up one by one.
FEW = 4
LEAST = 1e-30
U = np.uint64
END, START = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, with the tail in the last three bits, and where each text's begin."""
    hashes, first, data, starts, ends = vectors.words(texts, lower=True)
    if len(hashes):
        last = data[ends - 1].astype(U) * U(256) + data[np.maximum(ends - 2, starts)].astype(U)
        hashes = (hashes & ~U(7)) | (vectors.mix(last) % U(TAILS))
    n = np.diff(first)
    out = np.full(len(hashes) + len(n), END, U)
    at = first + np.arange(len(first))
    out[vectors.ranges(at[:-1], n)] = hashes
    return out, at


def _before(found: np.ndarray, at: np.ndarray, start=START) -> tuple[np.ndarray, np.ndarray]:
    """The token before each, and the one before that; start where a text has none."""
    one, two = np.empty_like(found), np.empty_like(found)
    one[1:], two[2:] = found[:-1], found[:-2]
    one[at[:-1]] = two[at[:-1]] = start
    second = at[:-1] + 1
    two[second[second < at[1:]]] = start
    return one, two


def _features(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hashes of the word before, the skipped-to word, and both."""
    return np.stack([vectors.mix(one ^ U(1)), vectors.mix(two ^ U(2)), vectors.mix(one * U(3) + vectors.mix(two))])


class Words:
    """Sorted hashes with counts; which of them are here changes no score, only where its count comes from."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        bits = len(hashes).bit_length() + 2
        self.shift = U(64 - bits)
        # where the hashes with each value of the leading bits begin
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=U)).astype(np.int32)

    def look(self, found: np.ndarray) -> np.ndarray:
        """Place of each token, -1 for those that are not here."""
        lead = (found >> self.shift).astype(np.int64)
        at, end = np.take(self.first, lead).astype(np.int64), np.take(self.first, lead + 1)
        place, left = np.full(len(found), -1), np.flatnonzero(at < end)
        while len(left):
            same = np.take(self.hashes, at[left]) == found[left]
            place[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return place


def _by_mass(mass: np.ndarray) -> np.ndarray:
    """Of numbers in falling order, WIDTH groups of about equal sums, side by side; the largest are alone."""
    group = np.minimum((np.cumsum(mass) - mass) / max(mass.sum(), 1) * WIDTH, WIDTH - 1).astype(np.int64)
    return np.unique(group, return_inverse=True)[1]


class Model:
    """What tasks need: the head's words and their ways through the nodes, biases, weights, the tails' sums of counts."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, tails: np.ndarray):
        self.head, self.total, self.distinct, self.tails = Words(hashes, counts), total, distinct, tails
        n = len(self.head.hashes)
        self.rank = np.lexsort((self.head.hashes, -self.head.counts))  # places, the commonest word first
        self.cluster, self.group, self.slot, self.rest = (np.zeros(n, t) for t in (np.int64, np.int64, np.int64, float))
        self.rows = 1 << int(np.clip(np.ceil(np.log2(total / SHARE + 1)), 10, np.log2(ROWS)))
        self.bias = np.full((1 + CLUSTERS + CLUSTERS * WIDTH, WIDTH), EMPTY, np.float32)
        self.keys = vectors.mix(np.arange(len(self.bias), dtype=U) + U(77))
        self.weights = np.zeros((self.rows, WIDTH), np.float32)
        self.set_ways()

    def set_clusters(self, near: np.ndarray) -> None:
        """near[i, s] counts how often seed s stands beside the word of rank i."""
        x = np.log1p(near)
        x = x - x.sum(0) / max(len(x), 1)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
        k = min(CLUSTERS, len(x))
        weight = self.head.counts[self.rank].astype(float)[:, None] ** 0.5
        centres = x[np.linspace(0, min(len(x), 4096) - 1, k).astype(int)] if k else x
        found = np.zeros(len(x), np.int64)
        for _ in range(15 if k else 0):
            found = (x @ centres.T).argmax(1)
            for j in range(k):
                if (mine := found == j).any():
                    c = (x[mine] * weight[mine]).sum(0)
                    centres[j] = c / (np.linalg.norm(c) + 1e-9)
        self.cluster[self.rank] = found
        self.set_ways()

    def set_ways(self) -> None:
        """Groups, slots, shares and biases from counts and clusters."""
        mass = self.head.counts + 0.5
        self.bias[:] = EMPTY
        self.slot[:] = -1
        root = np.concatenate([np.bincount(self.cluster, mass, minlength=CLUSTERS), self.tails])
        self._set_bias(0, root)
        for c in range(CLUSTERS):
            words = self.rank[self.cluster[self.rank] == c]
            if not len(words):
                continue
            group = _by_mass(mass[words])
            self.group[words] = group
            self._set_bias(1 + c, np.bincount(group, mass[words]))
            for g in np.flatnonzero(np.bincount(group) > 1):
                some = words[group == g]
                slot = _by_mass(mass[some])
                self.slot[some] = slot
                sums = np.bincount(slot, mass[some])
                self._set_bias(1 + CLUSTERS + c * WIDTH + g, sums)
                self.rest[some] = np.log(mass[some] / sums[slot])

    def _set_bias(self, node: int, mass: np.ndarray) -> None:
        some = np.flatnonzero(mass > 0)
        self.bias[node, some] = np.log(mass[some] / mass.sum())

    def levels(self, found: np.ndarray, features: np.ndarray, place: np.ndarray | None = None) -> Iterator[tuple[np.ndarray | slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(which tokens, their nodes, the outputs that they take, feature rows) of each step on the tokens' ways; place is theirs in the head, if known."""
        mask = U(self.rows - 1)
        place = self.head.look(found) if place is None else place
        inside = np.flatnonzero(place >= 0)
        out = CLUSTERS + (found & U(7)).astype(np.int64)
        out[inside] = self.cluster[place[inside]]
        yield slice(None), np.zeros(len(found), np.int64), out, (features ^ self.keys[0]) & mask
        for deep in (0, 1):
            p = place[inside]
            if deep:
                inside = inside[self.slot[p] >= 0]
                p = place[inside]
            c, g = self.cluster[p], self.group[p]
            node = 1 + CLUSTERS + c * WIDTH + g if deep else 1 + c
            yield inside, node, self.slot[p] if deep else g, (features[:2, inside] ^ self.keys[node]) & mask

    def logs(self, found: np.ndarray, at: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each token's probability, but for the count of a tail's word; place is the tokens' in the head, if known."""
        place = self.head.look(found) if place is None else place
        one, two = _before(found, at)
        out = np.zeros(len(found))
        for i in range(0, len(found), BATCH):
            part = slice(i, i + BATCH)
            mine, words = out[part], found[part]
            for which, node, taken, rows in self.levels(words, _features(one[part], two[part]), place[part]):
                if len(taken):
                    x = _scores(self.weights, self.bias, node, rows)
                    _, sums = _exps(x)
                    mine[which] += x[np.arange(len(taken)), taken] - np.log(sums)
        inside = place >= 0
        out[inside] += self.rest[place[inside]]
        out[~inside] -= np.log(self.tails[(found[~inside] & U(7)).astype(np.int64)])
        return out


def _scores(weights: np.ndarray, bias: np.ndarray, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of each token's rows and its node's biases."""
    x = np.take(bias, node, 0)
    for r in rows:
        x += np.take(weights, r.astype(np.int64), 0)
    return x


def _exps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of scores and their sums by token; where they leave the range of floats, x loses each token's largest first."""
    ones = np.ones(x.shape[1], x.dtype)
    with np.errstate(over="ignore"):
        exps = np.exp(x)
        sums = exps @ ones
    if not (sums.min() > LEAST and sums.max() < 1 / LEAST):
        x -= x.max(1, keepdims=True)
        exps = np.exp(x)
        sums = exps @ ones
    return exps, sums


def _by_row(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows met, how often, sums of x over each); those met once are copied, not summed."""
    keys = np.sort((rows.ravel() << U(32)) | np.tile(np.arange(len(x), dtype=U), len(rows)))
    every, order = keys >> U(32), (keys & U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    times = np.diff(np.append(new, len(every)))
    sums, left = np.take(x, order[new], 0), np.flatnonzero(times > 1)
    few, many = left[times[left] <= FEW], left[times[left] > FEW]
    for i in range(1, FEW):
        few = few[times[few] > i]
        sums[few] = np.take(sums, few, 0) + np.take(x, order[new[few] + i], 0)
    if len(many):
        take = vectors.ranges(new[many], times[many])
        sums[many] = np.add.reduceat(np.take(x, order[take], 0), np.cumsum(times[many]) - times[many])
    return every[new].astype(np.int64), times, sums


def _summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(keys))) if n is None else np.add.reduceat(n[order], new) if len(new) else n
    return keys[new], counts


def _counter(key_of):
    """For mapInArrow: (key, n) of what key_of finds in the tokens of each slice, summed as far as memory is bounded."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def flush():
            k, n = _summed(np.concatenate(keys), np.concatenate(counts))
            return k, n

        for b in vectors.slices(batches):
            k, n = _summed(key_of(*tokens(b.column("text"))))
            keys.append(k)
            counts.append(n)
            held += len(k)
            if held > 4_000_000:
                k, n = flush()
                if len(k) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["key", "n"])
                    k, n = k[:0], n[:0]
                keys, counts, held = [k], [n], len(k)
        if keys:
            k, n = flush()
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["key", "n"])

    return count


def _counts(texts: DataFrame, key_of) -> DataFrame:
    return texts.mapInArrow(_counter(key_of), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _collected(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a frame with a bounded number of rows."""
    table = counts.select("key", "n").toArrow()
    return table["key"].to_numpy().view(U), table["n"].to_numpy()


def _near(model):
    """Keys head word's rank * SEEDS + seed, for seeds (the commonest words) next to the word."""

    def key_of(found: np.ndarray, at: np.ndarray) -> np.ndarray:
        m = model.value
        rank = np.empty(len(m.rank) + 1, np.int64)
        rank[m.rank], rank[-1] = np.arange(len(m.rank)), -1
        head = rank[m.head.look(found)]
        left, right = head[:-1].copy(), head[1:]
        left[at[1:-1] - 1] = -1
        before = (left >= 0) & (left < SEEDS) & (right >= 0)
        after = (right >= 0) & (right < SEEDS) & (left >= 0)
        return np.concatenate([right[before].astype(U) * U(SEEDS) + left[before].astype(U), left[after].astype(U) * U(SEEDS) + right[after].astype(U)])

    return key_of


def _steps(model, rate: float):
    """AdaGrad over all tokens of a task; what it has met, as (block of rows, part, task, times met, weights times these)."""

    def steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, task, any_ = model.value, TaskContext.get().partitionId(), False
        weights = m.weights.copy()
        met, squares = np.zeros(m.rows, np.float32), np.full(m.rows, 1e-2, np.float32)
        for b in vectors.slices(batches):
            found, at = tokens(b.column("text"))
            one, two = _before(found, at)
            place = m.head.look(found)
            any_ = any_ or len(found) > 0
            for i in range(0, len(found), BATCH):
                part = slice(i, i + BATCH)
                for _, node, taken, rows in m.levels(found[part], _features(one[part], two[part]), place[part]):
                    if not len(taken):
                        continue
                    x, sums = _exps(_scores(weights, m.bias, node, rows))
                    x /= sums[:, None]
                    x[np.arange(len(taken)), taken] -= 1
                    ids, times, g = _by_row(x, rows)
                    squares[ids] += np.einsum("ij,ij->i", g, g)
                    g *= (rate / np.sqrt(squares[ids]))[:, None]
                    weights[ids] = np.take(weights, ids, 0) - g
                    met[ids] += times
        if any_:
            size = m.rows // BLOCKS
            weights *= met[:, None]
            for i in range(BLOCKS):
                s = slice(i * size, (i + 1) * size)
                yield _message(i, task % PARTS, task, met[s], weights[s])

    return steps


MESSAGE = "block int, part int, task int, met binary, weights binary"


def _message(block: int, part: int, task: int, met: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    row = (block, part, task, met.astype(np.float32).tobytes(), weights.astype(np.float32).tobytes())
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in MESSAGE.split(", ")])


def _added(messages: DataFrame, *keys: str) -> DataFrame:
    """Sums of messages of equal keys: sorted within partitions and added one by one, so a task holds one sum and one batch."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = met = weights = None
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                key = (row["block"], *[row[k] for k in keys if k != "block"])
                m, w = (np.frombuffer(row[c], np.float32).astype(float) for c in ("met", "weights"))
                if key == now:
                    met += m
                    weights += w
                    continue
                if now is not None:
                    yield _message(last["block"], last["part"], last["task"], met, weights)
                now, met, weights, last = key, m, w, row
        if now is not None:
            yield _message(last["block"], last["part"], last["task"], met, weights)

    return messages.repartition(*keys).sortWithinPartitions("block", "part", "task").mapInArrow(add, MESSAGE)


def _train(model: Model, texts: DataFrame, rate: float) -> None:
    """One round over all texts."""
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast(model)
    tasks = max(sc.defaultParallelism, -(-model.total // TASK_TOKENS))
    sums = _added(_added(texts.coalesce(tasks).mapInArrow(_steps(shared, rate), MESSAGE), "block", "part"), "block")
    # a block holds rows / BLOCKS rows: what comes back is as large as the weights, however many tasks there are
    size = model.rows // BLOCKS
    for row in sums.toLocalIterator():
        met, weights = np.frombuffer(row["met"], np.float32), np.frombuffer(row["weights"], np.float32).reshape(size, WIDTH)
        some = np.flatnonzero(met > 0)
        model.weights[row["block"] * size + some] = weights[some] / met[some, None]
    shared.unpersist()


def _least(counts: DataFrame, bins: dict[int, int], most: int) -> int:
    """A count that no more than `most` words reach, the least but for one part in 1024; bins has the words of each power of two."""
    b, left = 64, most
    while b and left >= bins.get(b - 1, 0):
        b, left = b - 1, left - bins.get(b - 1, 0)
    if not b:
        return 1
    low = 1 << (b - 1)
    width = max(1, low // 1024)
    part = F.floor((F.col("n") - low) / width)
    parts = {r["part"]: r["words"] for r in counts.where(f"n >= {low} and n < {2 * low}").groupBy(part.alias("part")).agg(F.count("*").alias("words")).collect()}
    p = low // width
    while left >= parts.get(p - 1, 0):
        p, left = p - 1, left - parts.get(p - 1, 0)
    return low + p * width


def learn(texts: DataFrame) -> tuple[Model, Words, DataFrame]:
    """The model of a frame with the column text, the commonest words, and the table of all counts (key, n)."""
    spark = texts.sparkSession
    storage.ship(spark)
    sc = spark.sparkContext
    counts = storage.materialise(_counts(texts, lambda found, at: found), "lm-counts")
    tail = F.col("key").bitwiseAND(F.lit(7))
    sums = counts.groupBy(tail.alias("tail")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    total, distinct = sum(r["n"] for r in sums), sum(r["words"] for r in sums)
    bins = {r["bin"]: r["words"] for r in counts.groupBy(F.floor(F.log2("n")).alias("bin")).agg(F.count("*").alias("words")).collect()}
    hashes, known = _collected(counts.where(f"n >= {_least(counts, bins, HEAD)}"))
    tails = np.zeros(TAILS)
    for r in sums:
        tails[r["tail"]] += r["n"] + 0.5 * r["words"]
    tails -= np.bincount((hashes & U(7)).astype(np.int64), known + 0.5, minlength=TAILS)
    model = Model(hashes, known, total, distinct, tails + 0.5)
    table = Words(*_collected(counts.where(f"n >= {_least(counts, bins, TABLE)}")))
    shared = sc.broadcast(model)
    keys, n = _collected(_counts(texts, _near(shared)))
    shared.unpersist()
    near = np.zeros((len(model.rank), SEEDS))
    near.ravel()[keys.astype(np.int64)] = n
    model.set_clusters(near)
    if total:
        _train(model, texts, RATE)
    return model, table, counts


def _score(model, table):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, t = model.value, table.value
        log_base = np.log10(m.total + 0.5 * (m.distinct + 1))
        for b in vectors.slices(batches):
            found, at = tokens(b.column("text"))
            head = m.head.look(found)
            logs = m.logs(found, at, head) / np.log(10)
            counts, inside, others = np.zeros(len(found), np.int64), head >= 0, np.flatnonzero(head < 0)
            counts[inside] = m.head.counts[head[inside]]
            place = t.look(found[others])
            counts[others[place >= 0]] = t.counts[place[place >= 0]]
            rare = counts == 0
            log_count = np.where(rare, 0.0, np.log10(counts + 0.5))
            logs += np.where(inside, 0.0, log_count)
            values = pa.array(found[rare].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare)])[at].astype(np.int32)), values)
            sums = [np.add.reduceat(x, at[:-1]) for x in (log_count - log_base, logs, (~rare).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("id"), b.column("held_out"), pa.array(np.diff(at)), *map(pa.array, sums), lists], names=["rid", "id", "held_out", "n_tokens", "base", "model", "known", "rare"])

    return score


def held_out(key: str, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % folds == fold, F.lit(False))


def scores(df: DataFrame, key: str = "doc_id", text: str = "text", held: Column | None = None) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; rows not held out are learned from."""
    spark = df.sparkSession
    held = held_out(key) if held is None else held
    every = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), held.alias("held_out"))
    model, table, counts = learn(every.where("not held_out").select("text"))
    kind = every.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(table)
    scored = every.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(
        _score(*shared), f"rid long, id {kind}, held_out boolean, n_tokens long, base double, model double, known long, rare array<long>"
    )
    scored = storage.materialise(scored, "lm-scored")
    # words that the table lacks: those with a count bring it, all others count as 0
    found = scored.select("rid", F.explode("rare").alias("key")).join(counts, "key")
    found = found.groupBy("rid").agg(F.sum(F.log10(F.col("n") + 0.5)).alias("logs"), F.count("*").alias("found"))
    none = F.coalesce("found", F.lit(0))
    more = F.coalesce("logs", F.lit(0.0)) + (F.size("rare") - none) * F.log10(F.lit(0.5))
    return scored.join(found, "rid", "left").select(
        F.col("id").alias(key), "held_out", "n_tokens", (F.col("known") + none).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )
