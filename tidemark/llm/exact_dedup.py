"""Exact dedup by an exchange of Golomb-coded fingerprints, with bytes compared for suspects only.

1. Every row's text loses its white space; a 64-bit fingerprint, a SHA-256 and the length stay in a table of a few
   bytes a row, along with the chunk (input partition) that the row was in.
2. Each chunk sends its distinct fingerprints, sorted and Golomb-coded, to the owner of each range of values; an
   owner answers each chunk with a bitmap of those that another chunk has, too. A fingerprint is sent once a chunk,
   so copies by the thousand cost no more than one.
3. Rows whose fingerprint is marked, or found twice in their chunk, are suspects; only texts with a suspect's
   fingerprint are grouped by their bytes, with partial sums before the shuffle, which also holds for a hot group.

Defined cases: a null text equals an empty one; among rows of equal text the one with the most code points stays,
then the smallest id (null last), then one of fully repeated rows; an empty table gives an empty result; other
columns pass through ``deduplicated`` and are left out of ``groups``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage, vectors

#: Rows whose fingerprints an owner has on average at most.
OWNED = 8_000_000
#: Bytes of a row of the tables that may be broadcast: a fingerprint, a group with its digest.
FINGERPRINT_BYTES, GROUP_BYTES = 16, 160


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def _prints(df: DataFrame, key: str, text: str) -> DataFrame:
    n = df.select(F.col(f"`{key}`").alias("id"), normalised(text).alias("t"), F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("points"))
    return n.select("id", "points", F.xxhash64("t").alias("print"), F.sha2("t", 256).alias("sha"), F.spark_partition_id().alias("chunk"), F.monotonically_increasing_id().alias("row"))


def _owner(values: np.ndarray, owners: int) -> np.ndarray:
    """Owners have ranges of equal width."""
    return ((values >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _split(values: np.ndarray, owners: int) -> list[tuple[int, np.ndarray]]:
    """(owner, its part) of sorted values, for owners with any."""
    found, at = np.unique_counts(_owner(values, owners))
    ends = np.cumsum(at)
    return [(int(o), values[e - n : e]) for o, n, e in zip(found, at, ends, strict=True)]


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _send(owners: int):
    def send(table: pa.Table) -> pa.Table:
        parts = _split(vectors.distinct(_unsigned(table["print"])), owners)
        rows = [(table["chunk"][0].as_py(), o, vectors.rice(v - v[0], int(v[-1] - v[0]) + 1), int(v[0].view(np.int64))) for o, v in parts]
        return pa.table([list(x) for x in zip(*rows, strict=True)], names=["chunk", "owner", "codes", "base"]).cast(
            pa.schema([("chunk", pa.int32()), ("owner", pa.int32()), ("codes", pa.binary()), ("base", pa.int64())])
        )

    return send


def _answer(table: pa.Table) -> pa.Table:
    """For each chunk's codes: a bit for each value, set if another chunk sent it, too."""
    bases = table["base"].to_numpy().view(np.uint64)
    sent = [vectors.unrice(c.as_py()) + b for c, b in zip(table["codes"], bases, strict=True)]
    every = np.sort(np.concatenate(sent))
    twice = vectors.distinct(every[1:][every[1:] == every[:-1]])
    bits = [np.packbits(np.isin(v, twice, assume_unique=True)).tobytes() for v in sent]
    return pa.table({"chunk": table["chunk"], "owner": table["owner"], "bits": pa.array(bits, pa.binary())})


def _mark(owners: int):
    def mark(rows: pa.Table, answers: pa.Table) -> pa.Table:
        prints = _unsigned(rows["print"])
        values, back, counts = np.unique(prints, return_inverse=True, return_counts=True)
        marked = counts > 1
        got = {o: b for o, b in zip(answers["owner"].to_pylist(), answers["bits"].to_pylist(), strict=True)}
        at = 0
        for o, v in _split(values, owners):
            marked[at : at + len(v)] |= np.unpackbits(np.frombuffer(got[o], np.uint8))[: len(v)].astype(bool)
            at += len(v)
        return rows.filter(pa.array(marked[back])).select(["id", "points", "print", "sha", "row"])

    return mark


def groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256 of each row (and points, its code points)."""
    spark = df.sparkSession
    storage.ship(spark)
    prints = storage.materialise(_prints(df, key, text), "prints")
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-prints.count() // OWNED))
    with storage.scratch(spark) as keep:
        kept = keep(_copies(df, prints, text, owners))
    alone = F.col("n").isNull()
    return prints.join(storage.small(kept, kept.count(), GROUP_BYTES), "sha", "left").select(
        F.col("id").alias(key),
        F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "points",
    )


def _copies(df: DataFrame, prints: DataFrame, text: str, owners: int) -> DataFrame:
    """(sha, n, keep, keep_row) of each group of two rows or more."""
    answers = (
        prints.select("chunk", "print").groupBy("chunk").applyInArrow(_send(owners), "chunk int, owner int, codes binary, base bigint")
        .groupBy("owner").applyInArrow(_answer, "chunk int, owner int, bits binary")
    )
    kind = prints.schema["id"].dataType.simpleString()
    suspects = storage.materialise(
        prints.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_mark(owners), f"id {kind}, points int, print bigint, sha string, row bigint"),
        "suspects",
    )
    marked = storage.materialise(suspects.select("print").distinct(), "marked")
    texts = df.select(normalised(text).alias("t")).withColumn("print", F.xxhash64("t"))
    verified = (
        texts.join(storage.small(marked, marked.count(), FINGERPRINT_BYTES), "print", "left_semi")
        .groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
        .select(F.sha2("t", 256).alias("sha"), "n")
    )
    best = suspects.groupBy("sha").agg(F.max(F.struct("points", (-F.col("id")).alias("minus"), (-F.col("row")).alias("minus_row"), "id", "row")).alias("best"))
    return storage.materialise(best.join(verified, "sha").select("sha", "n", F.col("best.id").alias("keep"), F.col("best.row").alias("keep_row")), "groups")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows without the copies, with df's columns. Texts are shuffled only if the dropped rows' keys are too many to broadcast."""
    found = storage.materialise(groups(df, key, text), "decisions")
    same = [F.col("__id").eqNullSafe(F.col("__i")), F.col("__points") == F.col("__p"), F.col("__sha") == F.col("__s")]
    keys = found.where("group_size > 1").groupBy(F.col(key).alias("__i"), F.col("points").alias("__p"), F.col("text_sha256").alias("__s")).agg(F.count_if("kept").alias("k"), F.count("*").alias("n"))
    keys = storage.materialise(keys, "dropped")
    columns = [F.col(f"`{c}`") for c in df.columns]
    named = df.withColumns({"__id": F.col(f"`{key}`"), "__points": F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))), "__sha": F.sha2(normalised(text), 256)})
    gone, repeated = keys.where("k = 0").select("__i", "__p", "__s"), keys.where("k > 0 and n > 1").select("__i", "__p", "__s")
    n = repeated.count()
    drop = storage.small(gone.union(repeated), gone.count() + n, GROUP_BYTES)
    kept = named.join(drop, same, "left_anti").select(*columns)
    if n:  # rows alike in id and text: one of each stays
        once = named.join(storage.small(repeated, n, GROUP_BYTES), same, "left_semi").dropDuplicates(["__id", "__points", "__sha"])
        kept = kept.unionByName(once.select(*columns))
    return kept
