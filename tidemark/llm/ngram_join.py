"""Exact n-gram Jaccard join by vertical partitioning of the global n-gram order.

The order of all n-grams is that of their hashes, cut into fragments (ranges). Three steps use it:

1. Documents with equal sets form a class. Each fragment gets its part of every document's set, as Rice-coded
   hashes with document places, and counts for each document how many of its n-grams some other document has, too.
   Summed over fragments, this bounds every overlap of the document; most fall below their own threshold here.
2. Of what is left, one member a class goes on. N-grams that the very same classes have make one element. Elements are
   ordered by frequency, each class probes with its rarest ones (prefix filter) within the sizes it can link with
   (length filter). Blocks of one element are first checked against one pivot each; classes that these links have
   joined are never compared again. The pairs left over, across components only, are then enumerated, so no link
   between components is lost.
3. A pair's parities, two to four bits an n-gram, bound its overlap from above; few pairs without a link pass. The
   overlap of those that do is counted in each fragment by itself and summed.

Defined cases: a document without words, or with a null text, has an empty set and links with nothing; one with
fewer words than an n-gram has its whole sequence as the only one; a null id never names a component (a component
of null ids only has a null name); rows with an id in common are told apart by their sets; an empty table gives an
empty result; other columns of the input pass through ``one_of_each`` and are left out of ``classes``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, storage, vectors

#: Words of an n-gram; a pair links if DEN * intersection >= NUM * union.
WORDS, NUM, DEN = 5, 80, 100
#: N-grams that a task gathers before it sends them, and that a fragment has on average at most.
SEND, FRAGMENT = 600_000, 1_000_000
#: Fragments in which a pair's overlap is counted.
PARTS = 4
U = np.uint64


def sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct n-gram hashes, sorted, one text after the other, and where each text's begin."""
    hashes, first, *_ = vectors.words(texts, lower=True)
    n = np.diff(first)
    starts = vectors.ranges(first[:-1], np.where(n >= size, n - size + 1, np.minimum(n, 1)))
    spans = np.repeat(np.minimum(n, size), np.where(n >= size, n - size + 1, np.minimum(n, 1)))
    grams = vectors.windows(hashes, starts, spans)
    ends = np.cumsum(np.where(n >= size, n - size + 1, np.minimum(n, 1)))
    found = [vectors.distinct(x) for x in np.split(grams, ends[:-1])] if len(n) else []
    return (np.concatenate(found) if found else grams), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)


def _signatures(values: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """16 bytes of each set that equal sets have in common; None for the empty set."""
    full = np.flatnonzero(np.diff(at) > 0)
    out: list[bytes | None] = [None] * (len(at) - 1)
    if len(full):
        two = [np.add.reduceat(vectors.mix(values ^ U(c)), at[full]) for c in (0x243F6A8885A308D3, 0x13198A2E03707344)]
        for i, a, b in zip(full, *two, strict=True):
            out[i] = a.tobytes() + b.tobytes()
    return out


def _describe(size: int):
    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vectors.slices(batches):
            values, at = sets(b.column("text"), size)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("id"), pa.array(np.diff(at)), pa.array(_signatures(values, at), pa.binary())], names=["k", "id", "n", "sig"])

    return describe


def _send(size: int, bits: int, fragments: int):
    """Messages of the documents' n-grams, cut to their first bits: (message, fragment, once, places, often, ids, counts).

    An n-gram that one document of the message has goes with that document's place; one that several have goes
    alone, as these are counted here already. So an n-gram that every document has costs one entry a message. A
    message's ids and own counts travel once, in a row that no fragment reads.
    """

    def message(number: int, ids: list[np.ndarray], grams: list[np.ndarray], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every, place = np.concatenate(grams), np.concatenate(places)
        every >>= U(64 - bits)
        order = np.argsort(every)
        every, place = every[order], place[order]
        same = every[1:] == every[:-1]
        lone = ~(np.append(False, same) | np.append(same, False))
        counts = np.bincount(place[~lone]).astype(np.uint32).tobytes()
        often, every, place = vectors.distinct(every[~lone]), every[lone], place[lone]
        place = place.astype(np.uint16 if len(place) and place.max() < 1 << 16 else np.uint32)
        bounds = _bounds(bits, fragments)
        edges, often_edges = np.searchsorted(every, bounds), np.searchsorted(often, bounds)
        width = (1 << bits) // fragments + 1
        rows = [(number, fragments + number % fragments, None, None, None, np.diff(np.concatenate(ids), prepend=0).tobytes(), counts)]
        for f in np.flatnonzero((np.diff(edges) > 0) | (np.diff(often_edges) > 0)).tolist():
            mine, many = slice(edges[f], edges[f + 1]), slice(often_edges[f], often_edges[f + 1])
            rows.append((number, f, vectors.rice(every[mine] - bounds[f], width), place[mine].tobytes(), vectors.rice(often[many] - bounds[f], width), None, None))
        for i in range(0, len(rows), 256):
            columns = zip(zip(*rows[i : i + 256], strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["message", "fragment", "once", "places", "often", "ids", "counts"])

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n, docs = TaskContext.get().partitionId() << 32, 0, 0
        ids, grams, places = [], [], []
        for b in vectors.slices(batches):
            values, at = sets(b.column("text"), size)
            ids.append(b.column("k").to_numpy())
            grams.append(values)
            places.append(np.repeat(np.arange(docs, docs + b.num_rows, dtype=np.uint32), np.diff(at)))
            n, docs = n + len(values), docs + b.num_rows
            if n >= SEND:
                yield from message(number, ids, grams, places)
                number, n, docs, ids, grams, places = number + 1, 0, 0, [], [], []
        if n:
            yield from message(number, ids, grams, places)

    return send


def _bounds(bits: int, fragments: int) -> np.ndarray:
    return np.array([-(-(i << bits) // fragments) for i in range(fragments + 1)], dtype=object).clip(0, (1 << 64) - 1).astype(U)


def _count(fragments: int):
    """In one fragment: for each message, the documents' places, once for each n-gram that another message has, too."""

    def count(table: pa.Table) -> pa.Table:
        if table["fragment"][0].as_py() >= fragments:
            return table.select(["message", "ids", "counts"])
        once = [vectors.unrice(x.as_py()) for x in table["once"]]
        every = np.concatenate(once + [vectors.unrice(x.as_py()) for x in table["often"]])
        order = np.argsort(every)
        every = every[order]
        same = every[1:] == every[:-1]
        shared = np.empty(len(every), bool)
        shared[order] = np.append(False, same) | np.append(same, False)
        out, at = [], 0
        for values, places in zip(once, table["places"], strict=True):
            place = np.frombuffer(places.as_py(), np.uint16 if len(places.as_py()) == 2 * len(values) else np.uint32)
            out.append(place[shared[at : at + len(values)]].astype(np.uint32).tobytes())
            at += len(values)
        return pa.table({"message": table["message"], "ids": pa.nulls(len(out), pa.binary()), "counts": pa.array(out, pa.binary())})

    return count


def _total(table: pa.Table) -> pa.Table:
    """Of a message: k of each document with shared n-grams, and how many."""
    total = np.zeros(1, np.int64)
    for i, c in zip(table["ids"], table["counts"], strict=True):
        part = np.frombuffer(c.as_py(), np.uint32)
        if i.is_valid:
            ids = np.cumsum(np.frombuffer(i.as_py(), np.int64))
        else:
            part = np.bincount(part)
        if len(part) > len(total):
            total = np.append(total, np.zeros(len(part) - len(total), np.int64))
        total[: len(part)] += part
    some = np.flatnonzero(total)
    return pa.table({"k": ids[some], "shared": total[some]})


def _parities(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of each set, whether the n-grams of a hash value are odd in number, for two to four values an n-gram: a power of two of bits, in words of 64."""
    out = []
    for v in np.split(vectors.mix(values), at[1:-1]) if len(at) > 1 else ():
        size = max(64, 1 << (2 * len(v) - 1).bit_length())
        odd = np.bincount((v & U(size - 1)).astype(np.int64), minlength=size) & 1
        out.append(np.packbits(odd.astype(bool)).view(np.int64))
    return out


def _members(size: int):
    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vectors.slices(batches):
            values, at = sets(b.column("text"), size)
            same = np.array([a == e for a, e in zip(_signatures(values, at), b.column("sig").to_pylist(), strict=True)], bool)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
            rows = pa.RecordBatch.from_arrays([b.column("k"), b.column("sig"), pa.array(np.diff(at)), lists, pa.array(_parities(values, at), pa.list_(pa.int64()))], names=["k", "sig", "n", "grams", "bits"])
            yield rows.filter(pa.array(same))

    return members


def _numbered(df: DataFrame) -> DataFrame:
    """df with a row number, written down so that it stays the same; ids can be null or occur twice."""
    return storage.materialise(df.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def _needed(n: str) -> str:
    """The smallest overlap that any link of a set of n n-grams has."""
    return f"ceil({NUM} * {n} / {DEN})"


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """key, n_shingles, component_id (smallest id that links reach) of each row."""
    rows = _placed(_numbered(df.select(F.col(f"`{key}`"), F.col(f"`{text}`"))), key, text, size)
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component")).otherwise(F.col("id")).alias("component_id"))


def _placed(numbered: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """k (row number), id, n, and of rows with copies or links: known, component (its smallest id), unnamed (its smallest k with a null id)."""
    spark = numbered.sparkSession
    storage.ship(spark)
    keyed = numbered.select(F.col("__row").alias("k"), F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    described = storage.materialise(keyed.mapInArrow(vectors.releasing(_describe(size)), "k long, id long, n long, sig binary"), "sets")
    total = described.agg(F.sum("n")).first()[0] or 0
    with storage.scratch(spark) as keep:
        named = keep(_named(spark, keyed, described, total, size))
    return described.join(storage.small(named, named.count(), 56), "sig", "left")


def _named(spark, keyed: DataFrame, described: DataFrame, total: int, size: int) -> DataFrame:
    """(sig, component, unnamed, known) of each class that may have copies or links."""
    bits = min(64, max(24, math.ceil(math.log2(total + 1)) + 12))
    fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FRAGMENT))
    shared = (
        keyed.mapInArrow(vectors.releasing(_send(size, bits, fragments)), "message long, fragment int, once binary, places binary, often binary, ids binary, counts binary")
        .groupBy("fragment").applyInArrow(vectors.releasing_group(_count(fragments)), "message long, ids binary, counts binary")
        .groupBy("message").applyInArrow(vectors.releasing_group(_total), "k long, shared long")
    )
    left = storage.materialise(described.join(shared, "k").where(f"shared >= {_needed('n')}").select("k", "id", "n", "sig"), "left")
    chosen = storage.materialise(left.groupBy("sig").agg(F.min("k").alias("k")), "chosen")
    members = (
        keyed.join(storage.small(chosen, chosen.count(), 40), "k")
        .mapInArrow(vectors.releasing(_members(size)), "k long, sig binary, n long, grams array<long>, bits array<long>")
        .dropDuplicates(["sig"])
        .select(F.monotonically_increasing_id().alias("rid"), "k", "sig", "n", "grams", "bits")
    )
    members = storage.materialise(members, "members")
    joined = graph.components(_links(members))
    of = members.select("rid", "sig").join(joined, F.col("rid") == F.col("node"), "left").select("sig", F.coalesce("component", "rid").alias("c"))
    smallest = left.join(of, "sig").groupBy("c").agg(F.min("id").alias("component"), F.min(F.when(F.col("id").isNull(), F.col("k"))).alias("unnamed"))
    return storage.materialise(of.join(smallest, "c").select("sig", "component", "unnamed", F.lit(True).alias("known")), "named")


def _links(members: DataFrame) -> DataFrame:
    """(a, b) with a < b: links enough to join all classes of a component."""
    probes = storage.materialise(_probes(_lists(members)), "probes")
    parts = storage.materialise(
        members.select("rid", "n", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), "grams")
        .select("rid", "n", "part", F.expr(f"filter(grams, x -> shiftrightunsigned(x, {64 - PARTS.bit_length() + 1}) = part)").alias("grams")),
        "parts",
    )
    pivots = probes.groupBy("block").agg(F.min(F.struct("alone", "rid", "n", "least", "most", "place")).alias("p")).select("block", "p.*").toDF("block", *[f"p_{x}" for x in ("alone", "rid", "n", "least", "most", "place")])
    star = probes.join(pivots, "block").where(f"rid <> p_rid and {_FITS}")
    star = storage.materialise(star.select(F.least("rid", "p_rid").alias("a"), F.greatest("rid", "p_rid").alias("b")).distinct(), "star")
    first = storage.materialise(_verified(_alike(star, members), parts), "verified")
    joined = graph.components(first)
    at = storage.materialise(probes.join(joined.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid")), "placed")
    return first.union(_verified(_alike(_across(at).join(star, ["a", "b"], "left_anti"), members), parts))


#: Two classes may link by sizes, and if this is the first element in both, by what is left after its places.
_FITS = f"n between p_least and p_most and p_n between least and most and least(n - place, p_n - p_place) >= ceil({NUM} * (n + p_n) / {NUM + DEN})"


def _lists(members: DataFrame) -> DataFrame:
    """rid, n, alone, least, most, elements (x, y, place): what each class shares with others, rarest first.

    N-grams of the very same classes, as those of a common passage, are one element; x and y are 128 bits of that set of
    classes. An element's place is the number of n-grams before it, `alone` that no other class has included.
    As an overlap is at most n - alone, DEN * i >= NUM * (n + m - i) bounds m from above, and i <= m from below.
    """
    every = members.select("rid", "n", F.explode("grams").alias("gram"))
    often = every.groupBy("gram").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y")).where("df > 1")
    some = every.join(often, "gram").groupBy("rid", "n").agg(F.count("*").alias("shared"), F.sort_array(F.collect_list(F.struct("df", "x", "y"))).alias("g"))
    starts = F.expr("filter(sequence(0, size(g) - 1), i -> i = 0 or g[i] <> g[greatest(i - 1, 0)])")
    return (
        some.where(f"shared >= {_needed('n')}")
        .withColumn("alone", F.expr("n - shared"))
        .withColumn("starts", starts)
        .select(
            "rid", "n", "alone", F.expr(f"ceil({NUM} * n / {DEN})").alias("least"), F.expr(f"floor(shared * {NUM + DEN} / {NUM}) - n").alias("most"),
            F.expr("transform(starts, i -> struct(g[i].x as x, g[i].y as y, alone + i as place))").alias("elements"),
        )
    )


def _probes(lists: DataFrame) -> DataFrame:
    """(block, rid, n, alone, least, most, place) of each element that may be the first that a class has in common with one it links with."""
    some = lists.withColumn("e", F.explode(F.expr(f"filter(elements, e -> e.place <= n - {_needed('n')})")))
    return some.select(F.struct("e.x", "e.y").alias("block"), "rid", "n", "alone", "least", "most", F.col("e.place").alias("place"))


def _across(at: DataFrame) -> DataFrame:
    """(a, b) of classes of one block and different components that may link."""
    blocks = (
        at.groupBy("block", "component").agg(F.count("*").alias("m"))
        .groupBy("block").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("kinds"))
        .where("kinds > 1").select("block", "main")
    )
    mixed = storage.materialise(at.join(blocks, "block"), "mixed")
    minor = mixed.where("component <> main").select("block", *[F.col(x).alias(f"p_{x}") for x in ("rid", "n", "least", "most", "place", "component")])
    return mixed.join(minor, "block").where(f"component <> p_component and {_FITS}").select(F.least("rid", "p_rid").alias("a"), F.greatest("rid", "p_rid").alias("b")).distinct()


def _alike(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs whose parities leave enough room: each odd difference is an n-gram that only one of the two has.

    The longer one of two rows of parities is folded to the length of the other.
    """
    a, b = (members.select(F.col("rid").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"b_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("m", F.least(F.size("b_a"), F.size("b_b")))
    both = both.withColumns({f"b_{x}": F.expr(f"aggregate(sequence(1, size(b_{x}) div m), array_repeat(0L, m), (z, i) -> zip_with(z, slice(b_{x}, (i - 1) * m + 1, m), (p, q) -> p ^ q))") for x in "ab"})
    odd = F.expr("aggregate(zip_with(b_a, b_b, (p, q) -> bit_count(p ^ q)), 0, (z, x) -> z + x)")
    return both.where(F.expr("n_a + n_b") - odd >= F.expr(f"2 * ceil({NUM} * (n_a + n_b) / {NUM + DEN})")).select("a", "b")


def _verified(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs that link: overlaps counted fragment by fragment, then summed."""
    a, b = (parts.select(F.col("rid").alias(x), "part", F.col("n").alias(f"n_{x}"), F.col("grams").alias(f"g_{x}")) for x in "ab")
    counted = pairs.join(a, "a").join(b, ["b", "part"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("g_a", "g_b")).alias("i"))
    total = counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("i").alias("i"))
    return total.where(f"{DEN} * i >= {NUM} * (n_a + n_b - i)").select("a", "b")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """df's rows without those whose component has a smaller id; rows with an id in common stay or go together.

    A row with a null id goes if its component has an id, or has such a row before it.
    """
    numbered = _numbered(df)
    found = storage.materialise(_placed(numbered, key, text, size).where("known").select("k", "id", "component", "unnamed"), "components")
    gone = storage.materialise(found.where("id <> component").select(F.col("id").alias("__gone")).distinct(), "gone")
    unnamed = storage.materialise(found.where("id is null and (component is not null or k <> unnamed)").select(F.col("k").alias("__gone")), "gone-unnamed")
    left = numbered.join(storage.small(gone, gone.count(), 16), F.col(f"`{key}`") == F.col("__gone"), "left_anti")
    return left.join(storage.small(unnamed, unnamed.count(), 16), F.col("__row") == F.col("__gone"), "left_anti").drop("__row")
