"""Hard negatives by a vantage-point tree over norm-augmented vectors.

With M the largest norm of a row, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0), |q' - x'|^2 = |q|^2 + M^2 - 2 q.x: high inner
products are near neighbours, and a window of scores is an annulus around the anchor.

The tree is made of a bounded sample: each node has one row as vantage point and the median distance to it; every row of the
table then goes down it to a leaf, and leaves keep the smallest and largest distance of their own rows to each vantage
point above. From these and an anchor's distances to the vantage points follows, by the triangle inequality, what scores
a leaf can hold for the anchor. Leaves outside an annulus are never visited. Those inside are visited nearest first, in
rounds of growing size, until the k-th row found is nearer than whatever the next leaf can hold; a round's answers are
a table in the shared folder. Answers are exact: bounds only leave out what cannot be among the first k.

A leaf's rows are held in blocks of about BLOCK rows, so a leaf of equal rows is many blocks; a task holds one block and
streams the anchors sent to it, so neither grows with the table. Anchors travel once a block they visit.

Components become floor(scale * x) as whole numbers. Scores are computed in doubles while these are exact, else in whole
numbers, and must be below 2 ** 62.

Defined cases: a row with a null id, label or vector, or with a null or non-finite component, takes no part; vectors of
other lengths than the longest end in zeros; rows of equal id are rows of their own, each an anchor or a candidate, and
each may be the other's positive; an anchor without positives, or a window without rows, gives no rows; equal scores go by
the smaller id; an empty table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import storage

SCALE = 256
#: Positives of an anchor, negatives of each, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows that the tree is made of, rows a leaf has on average (while DEPTH allows) and a block holds.
SAMPLE, LEAF, BLOCK, DEPTH = 16384, 512, 1024, 12
#: Leaves an anchor visits in the first round, and how many times as many in the next.
FIRST, GROW = 4, 8
#: Anchors scored at once.
STEP = 128
#: A block's bounds and a query's answers are rounded outwards by this share.
SLACK = 1e-7
_ANY = 1 << 62


def _whole(scale: int):
    """(k, id, label, norm2, v) of the rows that take part."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("v")
            offsets = vectors.offsets.to_numpy()
            flat = vectors.values.cast(pa.float64())
            x = np.floor(scale * flat.to_numpy(zero_copy_only=False))  # null is NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x) | (np.abs(x) >= 2.0**62))])
            ok = (bad[offsets[1:]] == bad[offsets[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
            x = np.where(np.isfinite(x) & (np.abs(x) < 2.0**62), x, 0.0).astype(np.int64)
            squares = np.concatenate([[0.0], np.cumsum(x.astype(float) ** 2)])
            lists = pa.ListArray.from_arrays(vectors.offsets, pa.array(x))
            rows = pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("anchor"), pa.array(squares[offsets[1:]] - squares[offsets[:-1]]), lists], names=["id", "label", "anchor", "norm2", "v"])
            yield rows.filter(pa.array(ok))

    return whole


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The lists as rows of whole numbers, shorter ones ending in zeros."""
    n, offsets = len(lists), lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if n and (sizes == width).all():
        return values[offsets[0] : offsets[-1]].reshape(n, width)
    out = np.zeros((n, width), np.int64)
    for i in range(n):
        out[i, : sizes[i]] = values[offsets[i] : offsets[i + 1]]
    return out


class Tree:
    """Vantage points in heap order; node i's children are 2i + 1 (near) and 2i + 2 (far), leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, most2: float, depth: int, seed: int = 11):
        self.width, self.depth, self.most2 = sample.shape[1], depth, most2
        n = (1 << depth) - 1
        self.points, self.far, self.split = np.zeros((n, self.width)), np.zeros(n), np.zeros(n)
        rng, lift = np.random.default_rng(seed), np.sqrt(np.maximum(most2 - (sample.astype(float) ** 2).sum(1), 0))
        rows = {0: np.arange(len(sample))}
        for node in range(n):
            own = rows.pop(node, np.zeros(0, np.int64))
            if len(own):
                # of a few rows the one whose distances differ most tells rows apart best
                some = [(self._to(sample, lift, own, p), p) for p in rng.choice(own, min(4, len(own)), False)]
                d, p = max(some, key=lambda x: float(np.var(x[0])))
                self.points[node], self.far[node], self.split[node] = sample[p], lift[p], np.median(d)
                rows[2 * node + 1], rows[2 * node + 2] = own[d <= self.split[node]], own[d > self.split[node]]

    @staticmethod
    def _to(sample, lift, own, p) -> np.ndarray:
        return np.sqrt(((sample[own] - sample[p]).astype(float) ** 2).sum(1) + (lift[own] - lift[p]) ** 2)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf of each row, distances to the vantage points on its way)."""
        x = x.astype(float)
        lift = np.sqrt(np.maximum(self.most2 - (x**2).sum(1), 0))
        node, ways = np.zeros(len(x), np.int64), np.zeros((len(x), self.depth))
        for level in range(self.depth):
            d = np.sqrt(((x - self.points[node]) ** 2).sum(1) + (lift - self.far[node]) ** 2)
            ways[:, level] = d
            node = 2 * node + 1 + (d > self.split[node])
        return node - ((1 << self.depth) - 1), ways

    def scores(self, q: np.ndarray, leaves: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that each leaf can hold for each anchor; low and high: leaves by levels, distances of their rows."""
        q2 = (q.astype(float) ** 2).sum(1)
        if not self.depth:
            shape = (len(q), len(leaves))
            return np.full(shape, -np.inf), np.full(shape, np.inf)
        to = np.sqrt(np.maximum(q2[:, None] + self.most2 - 2 * (q.astype(float) @ self.points.T), 0))
        near, away = np.zeros((len(q), len(leaves))), np.full((len(q), len(leaves)), np.inf)
        node = leaves + (1 << self.depth) - 1
        for level in range(self.depth - 1, -1, -1):
            node = (node - 1) >> 1
            d = to[:, node]
            near = np.maximum(near, np.maximum(d - high[:, level], low[:, level] - d))
            away = np.minimum(away, d + high[:, level])
        room = SLACK * (q2[:, None] + self.most2 + 1)
        top = (q2[:, None] + self.most2 - near**2) / 2 + room
        return (q2[:, None] + self.most2 - away**2) / 2 - room, top


def _placed(tree):
    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for b in batches:
            leaf, ways = t.place(_matrix(b.column("v"), t.width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), *[pa.array(ways[:, i]) for i in range(t.depth)]], names=[*b.schema.names, "leaf", *[f"d{i}" for i in range(t.depth)]])

    return placed


def _visits(index, first: int, last: int, k: int):
    """Of each anchor (a row with its windows and what they have found so far), a row for each leaf it visits in this round.

    first and last: places in the order of nearness that belong to the round. A window has low and high scores, the number
    of rows found and the k-th one's score; a leaf is needed while it may hold a score in the window that is no lower.
    """

    def visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, leaves, low, high, blocks = index.value
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                b = batch.slice(start, STEP)
                q = _matrix(b.column("v"), tree.width)
                least, most = tree.scores(q, leaves, low, high)
                sizes = np.diff(b.column("low").offsets.to_numpy())
                owner = np.repeat(np.arange(b.num_rows), sizes)
                lo, hi, found, kth = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("low", "high", "found", "kth"))
                bar = np.where(found >= k, np.maximum(lo, kth), lo)
                reach = np.minimum(most[owner], hi[:, None])  # by leaf and window: the best score that may be there
                inside = (most[owner] >= lo[:, None]) & (least[owner] <= hi[:, None]) & (lo <= hi)[:, None]
                # nearest first: how many leaves of the window's annulus come before
                order = np.argsort(np.where(inside, -reach, np.inf), axis=1, kind="stable")
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(leaves)), order.shape), 1)
                need = inside & (reach >= bar[:, None]) & (rank >= first) & (rank < last)
                window, at = np.nonzero(need)
                if not len(window):
                    continue
                # one row an anchor and leaf, with the windows that need it
                key = owner[window] * len(leaves) + at
                by = np.argsort(key, kind="stable")
                key, window = key[by], window[by]
                begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                row, leaf = key[begin] // len(leaves), key[begin] % len(leaves)
                offsets = pa.array(np.append(begin, len(key)).astype(np.int32))
                local = window - np.concatenate([[0], np.cumsum(sizes)])[owner[window]]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (local.astype(np.int32), bar[window], hi[window])]  # rows below what is found already need not come back
                chosen = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaves[leaf]), pa.array(blocks[leaf]), *[chosen.column(c) for c in ("k", "label", "v")], *lists], names=["leaf", "blocks", "k", "label", "v", "w", "low", "high"]
                )

    return visits


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles if no sum can leave the exact ones."""
    size = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    return (q.astype(float) @ x.T.astype(float)).astype(np.int64) if size < 2**53 else q @ x.T


def _search(width: int, k: int, same: bool):
    """Streams blocks, each followed by the anchors that visit it; keeps of each window the k best rows of the block."""

    def best(rows: tuple, b: pa.RecordBatch) -> pa.RecordBatch | None:
        ks, ids, labels, x = rows
        out = []
        for start in range(0, b.num_rows, STEP):
            part = b.slice(start, STEP)
            s = _exact(_matrix(part.column("v"), width), x)
            q, mine = part.column("k").to_numpy(), part.column("label").to_numpy()
            fits = (labels[None] == mine[:, None]) & (ks[None] != q[:, None]) if same else labels[None] != mine[:, None]
            owner = np.repeat(np.arange(part.num_rows), np.diff(part.column("w").offsets.to_numpy()))
            w, lo, hi = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("w", "low", "high"))
            s = s[owner]
            ok = fits[owner] & (s >= lo[:, None]) & (s <= hi[:, None])
            # rows of a block are in order of id, so the first of equal scores are those that count
            for _ in range(min(k, x.shape[0])):
                at = np.where(ok, s, -_ANY - 1).argmax(1)
                i = np.flatnonzero(ok[np.arange(len(at)), at])
                if not len(i):
                    break
                at = at[i]
                out.append((q[owner[i]], w[i], s[i, at], ids[at], ks[at]))
                ok[i, at] = False
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["q", "w", "score", "id", "k"])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, rows = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("leaf", "block", "kind")], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for a, e in zip(edges, edges[1:]):
                b, (leaf, block, kind) = batch.slice(a, e - a), keys[a].tolist()
                if (leaf, block) != now:
                    now, parts, rows = (leaf, block), [], None
                if kind == 0:
                    parts.append(b)
                    continue
                if rows is None:
                    t = pa.Table.from_batches(parts).combine_chunks() if parts else None
                    parts = []
                    if t is None:
                        continue
                    ids = t["id"].to_numpy()
                    order = np.argsort(ids, kind="stable")
                    rows = (t["k"].to_numpy()[order], ids[order], t["label"].to_numpy()[order], _matrix(t["v"].chunk(0), width)[order])
                if (found := best(rows, b)) is not None:
                    yield found

    return search


_FOUND = "q long, w int, score long, id long, k long"


class Index:
    """The placed rows of a table of vectors, and the tree with its leaves' bounds."""

    def __init__(self, df: DataFrame, key: str, label: str, vector: str, anchor: Column, scale: int, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK):
        self.spark = df.sparkSession
        storage.ship(self.spark)
        every = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(f"`{vector}`").alias("v"))
        every = every.where("id is not null and label is not null and v is not null").mapInArrow(_whole(scale), "id long, label long, anchor boolean, norm2 double, v array<long>")
        rows = storage.materialise(every.withColumn("k", F.monotonically_increasing_id()), "vectors")
        n, most, width = rows.agg(F.count("*"), F.max("norm2"), F.max(F.size("v"))).first()
        self.n = n
        if not n:
            return
        share = int(min(1.0, sample / n) * (1 << 31))
        drawn = rows.where(F.xxhash64("k").bitwiseAND(F.lit((1 << 31) - 1)) < share).select("id", "k", "v").limit(2 * sample).collect()
        drawn.sort(key=lambda r: (r["id"], r["k"]))
        depth = min(DEPTH, max(0, math.ceil(math.log2(n / leaf)))) if drawn else 0
        vectors = np.zeros((len(drawn), width), np.int64)
        for i, r in enumerate(drawn):
            vectors[i, : len(r["v"])] = r["v"]
        self.tree = Tree(vectors, most, depth)
        levels = [f"d{i}" for i in range(depth)]
        schema = "id long, label long, anchor boolean, norm2 double, v array<long>, k long, leaf long" + "".join(f", {c} double" for c in levels)
        placed = storage.materialise(rows.mapInArrow(_placed(self.spark.sparkContext.broadcast(self.tree)), schema), "placed")
        bounds = placed.groupBy("leaf").agg(F.count("*"), *[f(c) for c in levels for f in (F.min, F.max)]).orderBy("leaf").collect()  # a row a leaf, 2 ** DEPTH at most
        leaves = np.array([r[0] for r in bounds])
        room = SLACK * math.sqrt(most + 1)
        low = np.array([[r[2 + 2 * i] - room for i in range(depth)] for r in bounds]).reshape(len(bounds), depth)
        high = np.array([[r[3 + 2 * i] + room for i in range(depth)] for r in bounds]).reshape(len(bounds), depth)
        blocks = np.array([-(-r[1] // block) for r in bounds])
        self.leaves = len(leaves)
        self.bounds = self.spark.sparkContext.broadcast((self.tree, leaves, low, high, blocks))
        of = self.spark.createDataFrame([(int(a), int(b)) for a, b in zip(leaves, blocks, strict=True)], "leaf long, blocks long")
        self.rows = storage.materialise(placed.join(F.broadcast(of), "leaf").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks"))).select("leaf", "block", "k", "id", "label", "anchor", "v"), "indexed")

    def nearest(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """q, w, score, id, k: of each anchor (k, label, v, windows low and high) and window the k best other rows of its own label, or of others."""
        with storage.scratch(self.spark) as keep:
            anchors = storage.materialise(anchors, "anchors")
            found, first, last = None, 0, FIRST
            while first < self.leaves:
                if found is None:
                    state = anchors.withColumn("of", F.expr("cast(map() as map<int, struct<found: long, kth: long>>)"))
                else:
                    each = found.groupBy("q", "w").agg(F.struct(F.count("*").alias("found"), F.min("score").alias("kth")).alias("x"))
                    each = each.groupBy(F.col("q").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("of"))  # an entry a window
                    state = anchors.join(each, "k", "left")
                window = "transform(sequence(0, size(low) - 1), w -> coalesce({}, cast({} as long)))"
                state = state.select("k", "label", "v", "low", "high", F.expr(window.format("of[w].found", 0)).alias("found"), F.expr(window.format("of[w].kth", -_ANY)).alias("kth"))
                sent = (
                    state.mapInArrow(_visits(self.bounds, first, last, k), "leaf long, blocks long, k long, label long, v array<long>, w array<int>, low array<long>, high array<long>")
                    .select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "k", F.lit(None).cast("long").alias("id"), "label", "v", "w", "low", "high")
                )
                nothing = {"w": F.lit(None).cast("array<int>"), "low": F.lit(None).cast("array<long>"), "high": F.lit(None).cast("array<long>")}
                both = self.rows.select("leaf", "block", F.lit(0).alias("kind"), "k", "id", "label", "v").withColumns(nothing).unionByName(sent)
                new = both.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind").mapInArrow(_search(self.tree.width, k, same), _FOUND)
                best = W.partitionBy("q", "w").orderBy(F.desc("score"), "id", "k")
                new = new if found is None else new.unionByName(found)
                found = storage.materialise(new.withColumn("__i", F.row_number().over(best)).where(F.col("__i") <= k).drop("__i"), "found")
                first, last = last, last * GROW
            return keep(found)


def mined(
    df: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of each anchor row (a condition) and each of
    its first positives, the first rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score."""
    spark = df.sparkSession
    with storage.scratch(spark) as keep:
        index = Index(df, key, label, vector, anchor, scale, sample, leaf, block)
        if not index.n:
            return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        anchors = index.rows.where("anchor").select("k", "id", "label", "v")
        every = anchors.select("k", "label", "v", F.array(F.lit(-_ANY)).alias("low"), F.array(F.lit(_ANY)).alias("high"))
        place = W.partitionBy("q").orderBy(F.desc("score"), "id", "k")
        pairs = index.nearest(every, positives, True).select("q", (F.row_number().over(place) - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        # the quotients by 100, rounded up and down in whole numbers
        pairs = pairs.withColumn("low", F.expr(f"({low} * positive_score + pmod(-{low} * positive_score, 100)) div 100")).withColumn("high", F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100"))
        pairs = storage.materialise(pairs, "positives")
        of = pairs.groupBy(F.col("q").alias("k")).agg(F.array_sort(F.collect_list(F.struct("w", "low", "high"))).alias("s"))  # an entry a positive
        windows = anchors.join(of, "k").select("k", "label", "v", F.expr("s.low").alias("low"), F.expr("s.high").alias("high"))
        found = index.nearest(windows, negatives, False)
        rank = F.row_number().over(W.partitionBy("q", "w").orderBy(F.desc("score"), "id", "k")).alias("rank")
        found = found.select("q", "w", rank, F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        ids = anchors.select(F.col("k").alias("q"), F.col("id").alias("anchor_id"))
        out = found.join(pairs.select("q", "w", "positive_id", "positive_score"), ["q", "w"]).join(ids, "q")
        return keep(storage.materialise(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
