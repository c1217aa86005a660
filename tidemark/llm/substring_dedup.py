"""Substring dedup by fixed-block anchors: repeats of 20 words or more, wherever they start.

1. Each document's non-overlapping blocks of 10 words are the index; every rolling window of 10 words of every
   document probes it. Any window of 20 words holds a whole block, so a repeat's own block is probed by the other
   occurrence. Both sides go to the owner of their hash range as Rice-coded sorted hashes, a hash once a task; blocks
   that occur a second time come back as hits.
2. Hits are extended: the windows of 20 words around a hit block are compared with all others by hash, again through
   the owners of hash ranges. A task sends each window's first occurrence only, so a window that a third of all
   documents hold costs one entry a task. Windows that also start earlier come back and merge into maximal spans.
3. The spans' words go.

"Earlier" is a smaller id, or an earlier start in the same document. Defined cases: a null text has no words; a null
id is larger than all others; rows with an id in common count as one document for the order, and at equal start
neither is earlier; ids are whole numbers (other types are cast); rows are told apart by their id and a 128-bit hash of their text, so only rows alike in both share
their spans; windows are judged on the input, never on what is left; a very long text is one row's work, in about ten
times its size; an empty table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, vectors

#: Words of a window that may be removed, and of a block: any window holds a whole block.
WINDOW, BLOCK = 20, 10
#: Windows that a task gathers before it sends them, and that a fragment has on average at most.
SEND, FRAGMENT = 2_000_000, 2_000_000
NO_ID = (1 << 63) - 1
U = np.uint64

MESSAGE = "message long, fragment int, codes binary, a binary, b binary, c binary"


def _pack(x: np.ndarray) -> bytes:
    """Integers in as few bytes each as the largest needs."""
    x = np.asarray(x)
    low = int(x.min()) if len(x) else 0
    span = (int(x.max()) - low) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if span < 1 << (8 * w))
    return bytes([width]) + low.to_bytes(8, "little", signed=True) + (x - low).astype(f"<u{width}").tobytes()


def _unpack(code: bytes) -> np.ndarray:
    return np.frombuffer(code, f"<u{code[0]}", -1, 9).astype(np.int64) + int.from_bytes(code[1:9], "little", signed=True)


def _bounds(bits: int, fragments: int) -> np.ndarray:
    return np.array([min(-(-(i << bits) // fragments), (1 << 64) - 1) for i in range(fragments + 1)], U)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MESSAGE.split(", ")])


class _Sender:
    """Gathers arrays of one task, and sends them once there are enough; each message has a number of its own."""

    def __init__(self, build):
        self.build, self.number = build, TaskContext.get().partitionId() << 32
        self.clear()

    def clear(self):
        self.parts, self.ids, self.hashes, self.n, self.docs = [], [], [], 0, 0

    def add(self, batch: pa.RecordBatch, n: int, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        """arrays[1] has each entry's document, by place in the batch."""
        k = batch.column("k").to_numpy()
        arrays = (arrays[0], arrays[1] + self.docs, *arrays[2:])
        self.parts.append(arrays)
        self.ids.append(k)
        self.hashes.append(np.stack([batch.column("h").to_numpy(), batch.column("g").to_numpy()], 1))
        self.n, self.docs = self.n + n, self.docs + len(k)
        if self.n >= SEND:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            rows = self.build(self.number, np.concatenate(self.ids), np.concatenate(self.hashes), *[np.concatenate(x) for x in zip(*self.parts, strict=True)])
            for i in range(0, len(rows), 64):
                yield _batch(rows[i : i + 64])
            self.number += 1
        self.clear()


def _probe(bits: int, fragments: int):
    def build(number, ids, hashes, grams, docs, at):
        """Per fragment: distinct hashes, which of them occur twice here, and the blocks' places among them."""
        order = np.argsort(grams)
        grams, docs, at = grams[order], docs[order], at[order]
        new = np.concatenate([[True], grams[1:] != grams[:-1]])
        values, rank = grams[new], np.cumsum(new) - 1
        many = np.bincount(rank) > 1
        block = at % BLOCK == 0
        block_rank, block_doc, block_at = rank[block], docs[block], at[block] // BLOCK
        bounds = _bounds(bits, fragments)
        edges = np.searchsorted(values, bounds)
        block_edges = np.searchsorted(block_rank, edges)
        rows = [(number, fragments + number % fragments, None, _pack(ids), hashes.tobytes(), None)]
        for f, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                s = slice(block_edges[f], block_edges[f + 1])
                flags = np.packbits(many[a:b]).tobytes()
                ranks = vectors.rice((block_rank[s] - a).astype(U), int(b - a))
                head = len(flags).to_bytes(4, "little") + flags + ranks
                rows.append((number, f, vectors.rice(values[a:b] - bounds[f], (1 << bits) // fragments + 1), head, _pack(block_doc[s]), _pack(block_at[s])))
        return rows

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(build)
        for b in vectors.slices(batches):
            words, first, *_ = vectors.words(b.column("text"))
            n = np.diff(first)
            n = np.where(n >= WINDOW, n - BLOCK + 1, 0)
            starts = vectors.ranges(first[:-1], n)
            docs = np.repeat(np.arange(len(n)), n)
            grams = vectors.windows(words, starts, BLOCK) >> U(64 - bits)
            yield from sender.add(b, len(grams), grams, docs, starts - first[docs])
        yield from sender.end()

    return probe


def _tables(table: pa.Table, fragments: int) -> list[dict] | None:
    """The rows of a fragment; None if they are documents' ids, which pass through."""
    return None if table["fragment"][0].as_py() >= fragments else table.to_pylist()


def _passed(table: pa.Table) -> pa.Table:
    return table.select(["message", "a", "b", "c"])


def _answered(rows: list[dict], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """Documents and places for each message; c is left null, as ids pass with c too."""
    return pa.table({"message": [r["message"] for r in rows], "a": [_pack(d) for d, _ in found], "b": [_pack(p) for _, p in found], "c": pa.array([b""] * len(rows), pa.binary())})


def _hits(fragments: int):
    def hits(table: pa.Table) -> pa.Table:
        if (rows := _tables(table, fragments)) is None:
            return _passed(table)
        values = [vectors.unrice(r["codes"]) for r in rows]
        every = np.sort(np.concatenate(values))
        twice = vectors.distinct(every[1:][every[1:] == every[:-1]])
        found = []
        for r, v in zip(rows, values, strict=True):
            size = int.from_bytes(r["a"][:4], "little")
            hit = np.unpackbits(np.frombuffer(r["a"], np.uint8, size, 4))[: len(v)].astype(bool)
            if len(twice):
                at = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
                hit |= twice[at] == v
            block = hit[vectors.unrice(r["a"][4 + size :]).astype(np.int64)]
            found.append((_unpack(r["b"])[block], _unpack(r["c"])[block]))
        return _answered(rows, found)

    return hits


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, hashes, documents, places) of a message: its ids, and what all fragments have answered."""
    ids = hashes = None
    docs, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in table.to_pylist():
        if r["c"] == b"":
            docs.append(_unpack(r["a"]))
            places.append(_unpack(r["b"]))
        else:
            ids, hashes = _unpack(r["a"]), np.frombuffer(r["b"], np.int64).reshape(-1, 2)
            if r["c"] is not None:  # what the sender itself has found
                own = int.from_bytes(r["c"][:4], "little")
                docs.append(_unpack(r["c"][4 : 4 + own]))
                places.append(_unpack(r["c"][4 + own :]))
    return ids, hashes, np.concatenate(docs), np.concatenate(places)


def _blocks(table: pa.Table) -> pa.Table:
    ids, hashes, docs, places = _gathered(table)
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    some, at = np.unique(docs, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(docs)).astype(np.int32)), pa.array(places.astype(np.int32)))
    return pa.table({"k": ids[some], "h": hashes[some, 0], "g": hashes[some, 1], "blocks": lists})


def _extend(bits: int, fragments: int):
    def build(number, ids, hashes, grams, docs, at):
        """Per fragment: each window's first occurrence here (all, where they tie); the others are later ones for sure."""
        k = ids[docs]
        order = np.lexsort((at, k, grams))
        grams, docs, at, k = grams[order], docs[order], at[order], k[order]
        group = np.cumsum(np.concatenate([[True], grams[1:] != grams[:-1]])) - 1
        start = np.searchsorted(group, np.arange(group[-1] + 1))[group]
        later = (k != k[start]) | (at != at[start])
        own = _pack(docs[later])
        rows = [(number, fragments + number % fragments, None, _pack(ids), hashes.tobytes(), len(own).to_bytes(4, "little") + own + _pack(at[later]))]
        grams, docs, at, k = (x[~later] for x in (grams, docs, at, k))
        bounds = _bounds(bits, fragments)
        edges = np.searchsorted(grams, bounds)
        edges[-1] = len(grams)
        for f, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                rows.append((number, f, vectors.rice(grams[a:b] - bounds[f], (1 << bits) // fragments + 1), _pack(k[a:b]), _pack(docs[a:b]), _pack(at[a:b])))
        return rows

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(build)
        for b in vectors.slices(batches):
            words, first, *_ = vectors.words(b.column("text"))
            n = np.diff(first)
            blocks = b.column("blocks")
            doc = np.repeat(np.arange(len(n)), np.diff(blocks.offsets.to_numpy()))
            block = blocks.flatten().to_numpy().astype(np.int64)
            low, high = np.maximum(block * BLOCK + BLOCK - WINDOW, 0), np.minimum(block * BLOCK, n[doc] - WINDOW)
            m = np.maximum(high - low + 1, 0)
            starts = vectors.distinct(vectors.ranges(first[doc] + low, m))
            doc = np.searchsorted(first, starts, "right") - 1
            grams = vectors.windows(words, starts, WINDOW)
            yield from sender.add(b, len(grams), grams, doc, starts - first[doc])
        yield from sender.end()

    return extend


def _judge(fragments: int):
    def judge(table: pa.Table) -> pa.Table:
        if (rows := _tables(table, fragments)) is None:
            return _passed(table)
        grams = [vectors.unrice(r["codes"]) for r in rows]
        sizes = [len(x) for x in grams]
        grams, k, at = np.concatenate(grams), np.concatenate([_unpack(r["a"]) for r in rows]), np.concatenate([_unpack(r["c"]) for r in rows])
        order = np.lexsort((at, k, grams))
        new = np.concatenate([[True], grams[order][1:] != grams[order][:-1]])
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = np.zeros(len(order), bool)
        later[order] = (k[order] != k[first]) | (at[order] != at[first])
        found = []
        for r, mine, starts in zip(rows, np.split(later, np.cumsum(sizes)[:-1]), np.split(at, np.cumsum(sizes)[:-1]), strict=True):
            found.append((_unpack(r["b"])[mine], starts[mine]))
        return _answered(rows, found)

    return judge


def _spans(table: pa.Table) -> pa.Table:
    ids, hashes, docs, places = _gathered(table)
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    same = np.concatenate([[False], (docs[1:] == docs[:-1]) & (places[1:] <= places[:-1] + WINDOW)])[: len(docs)]
    begin = np.flatnonzero(~same)
    end = np.append(begin[1:], len(docs))[: len(begin)] - 1
    span_docs = docs[begin]
    some, at = np.unique(span_docs, return_index=True)
    offsets = pa.array(np.append(at, len(begin)).astype(np.int32))
    begins, ends = (pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (places[begin], places[end] + WINDOW))
    return pa.table({"k": ids[some], "h": hashes[some, 0], "g": hashes[some, 1], "begins": begins, "ends": ends})


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(t).alias("h"), F.xxhash64(F.lit(1), t).alias("g"), t.alias("text"))


def _joined(docs: DataFrame, side: DataFrame, column: str, how: str) -> DataFrame:
    """docs with side's lists; side is broadcast if its size allows."""
    rows, entries = side.agg(F.count("*"), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
    return docs.join(storage.small(side, 1, 56 * rows + 8 * entries), ["k", "h", "g"], how)


def spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, h, g, begins, ends): the maximal spans of words to remove of each document with any; k is the id, h and g hash the text."""
    spark = df.sparkSession
    storage.ship(spark)
    docs = _keyed(df, key, text)
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits = min(64, max(24, math.ceil(math.log2(chars / 5 + 1)) + 12))
    fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // (5 * FRAGMENT)))
    answer = "message long, a binary, b binary, c binary"
    with storage.scratch(spark) as keep:
        hits = (
            docs.mapInArrow(_probe(bits, fragments), MESSAGE)
            .groupBy("fragment").applyInArrow(_hits(fragments), answer)
            .groupBy("message").applyInArrow(_blocks, "k long, h long, g long, blocks array<int>")
        )
        # copies of a row find the same blocks: each goes on once, so a list is no longer than its text
        each = hits.select("k", "h", "g", F.explode("blocks").alias("block")).distinct()
        hits = storage.materialise(each.groupBy("k", "h", "g").agg(F.sort_array(F.collect_list("block")).alias("blocks")), "hits")
        found = (
            _joined(docs, hits, "blocks", "inner")
            .mapInArrow(_extend(64, fragments), MESSAGE)
            .groupBy("fragment").applyInArrow(_judge(fragments), answer)
            .groupBy("message").applyInArrow(_spans, "k long, h long, g long, begins array<int>, ends array<int>")
        )
        return keep(storage.materialise(found.dropDuplicates(["k", "h", "g"]), "spans"))


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in vectors.slices(batches):
        out = []
        for text, begins, ends in zip(*[b.column(c).to_pylist() for c in ("text", "begins", "ends")], strict=True):
            words, kept, at = text.encode().split(), [], 0
            for begin, end in zip(begins or (), ends or (), strict=True):
                kept += words[at:begin]
                at = end
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
        n, gone, left = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_text (kept words joined by one space) of each row."""
    cut = _joined(_keyed(df, key, text), spans(df, key, text), "begins", "left").mapInArrow(_cut, "id long, n_words long, n_removed long, kept_text string")
    return cut.select(F.col("id").alias(key), "n_words", "n_removed", "kept_text")
