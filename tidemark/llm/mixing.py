"""Mixing sources to target weights by hash-random order, range buckets and distributed prefix sums.

Every row gets a random key, md5 of seed and id. Rows whose id occurs more than once get one of their own: of seed, id,
size, a hash of the text and the row's number among those alike in all of these, counted by prefix sums over the
table's partitions; so a hot id, null included, spreads like any others. Within a source the keys are sorted by range:
rows fall into ranges of about RANGE_ROWS by the key's first digits, as many digits as the table needs; prefix sums over
coarse ranges and over the ranges in one give each range's start, and a window inside a range gives each row's own
start. A source whose budget is B and whose size is S is taken floor(B / S) times whole and once more up to B mod S;
the row at the cut is taken in part, so a source's sum is its budget to the word. A hot source is fine: no group is
larger than one range of one source. Sources' totals, a short row each, are sorted in one task.

Defined cases: a null source is a source of its own, last in order; a null text has size 0, as an empty one; a text of
any length counts whole; sources of size 0 have target 0; of rows alike in id, source and text it does not matter which
is which; an empty table gives an empty result; other columns of the input are kept by ``mixed_rows`` and left out by
``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import storage

WEIGHTS = (3, 1, 2)
#: Words asked for, as a share of all there are, and the most a source may give, in times of its size.
SHARE, MOST = 1.5, 2
#: Rows of a range of keys at most, on average over the table.
RANGE_ROWS = 1024
#: A cut's size in memory, for the check before it is broadcast.
CUT_BYTES, ID_BYTES, KEY_BYTES = 200, 64, 80


def _columns(key: str, text: str, seed: str) -> tuple[Column, Column, Column]:
    """Random key, id and size in words of a row."""
    bare = F.expr(f"trim(both ' \t\n\x0b\x0c\r' from coalesce(`{text}`, ''))")
    size = F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")
    r = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))))
    return r, F.col(f"`{key}`"), size


def _keyed(df: DataFrame, key: str, text: str, source: str, seed: str, row: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(row, id, source, size in words and random key r of each row; the ids that occur more than once, if any)."""
    r, id_, size = _columns(key, text, seed)
    row = F.monotonically_increasing_id() if row is None else row
    rows = df.select(row.alias("row"), id_.alias("id"), F.col(f"`{source}`").alias("source"), size.alias("size"), r.alias("r"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    rows = storage.materialise(rows, "mix")
    ids = storage.materialise(rows.groupBy(F.col("id").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"), "mix-ids")
    n = ids.count()
    if not n:
        return rows, None
    several, part = rows.join(storage.small(ids, n, ID_BYTES), _same("id", "again")).drop("again"), F.shiftright("row", 33).alias("part")
    alike = ["id", "source", "size", "h"]
    before = W.partitionBy(*alike).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = several.groupBy(*alike, part).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).where("start > 0").select(*[F.col(c).alias(f"p_{c}") for c in (*alike, "part")], "start")
    on = [_same(c, f"p_{c}") for c in (*alike, "part")]
    own = F.row_number().over(W.partitionBy(*alike, "part").orderBy("row")) + F.coalesce("start", F.lit(0))
    numbered = several.withColumn("part", part).join(parts, on, "left").withColumn("place", own)
    numbered = numbered.withColumn("r", F.md5(F.concat_ws(":", "r", F.col("size").cast("string"), F.col("h").cast("string"), F.col("place").cast("string"))))
    once = rows.join(storage.small(ids, n, ID_BYTES), _same("id", "again"), "left_anti")
    return storage.materialise(once.unionByName(numbered.select(*rows.columns)), "mix-keys"), ids


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target of each source: shares by weight, none above most times its source's size.

    The level of the fill follows from one sorted pass: with sources by size over weight, a source is full if its
    cap is no more than its weight's share of what the sources before it have left.
    """
    one = W.orderBy(F.col("source").asc_nulls_last())
    filled = W.orderBy("ratio", "place")
    rest = filled.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    by_weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(one) - 1)
        .withColumn("weight", by_weight)
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
        .withColumn("at", F.min(F.when(~F.col("full"), F.struct("ratio", "place", "level"))).over(W.partitionBy()))
    )
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("at.level")))
    return s.select("source", "source_size", target.alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """key, source, size, source_size, target, taken (words that the mix takes, repeats counted) of each row."""
    sized, _ = _keyed(df, key, text, source, seed)
    return _take(sized, weights, share, most).select(F.col("id").alias(key), "source", "size", "source_size", "target", "taken", "r", "epochs")


def _take(sized: DataFrame, weights, share, most) -> DataFrame:
    goal = targets(sized, weights, share, most)
    digits = max(2, math.ceil(math.log(max(sized.count(), 1) / RANGE_ROWS, 16)))
    ranged = sized.withColumn("range", F.substring("r", 1, digits))
    coarse = F.substring("b", 1, digits // 2)
    ranges = ranged.groupBy(F.col("source").alias("s"), F.col("range").alias("b")).agg(F.sum("size").alias("n")).withColumn("c", coarse)
    earlier = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    firsts = ranges.groupBy(F.col("s").alias("s2"), F.col("c").alias("c2")).agg(F.sum("n").alias("n")).select("s2", "c2", F.coalesce(F.sum("n").over(earlier("s2").orderBy("c2")), F.lit(0)).alias("first"))
    starts = (
        ranges.withColumn("inner", F.coalesce(F.sum("n").over(earlier("s", "c").orderBy("b")), F.lit(0)))
        .join(firsts, _same("s", "s2") & (F.col("c") == F.col("c2")))
        .join(goal.withColumnRenamed("source", "g"), _same("s", "g"))
        .select("s", "b", (F.col("first") + F.col("inner")).alias("start"), "source_size", "target")
    )
    inside = W.partitionBy("source", "range").orderBy("r", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    return (
        ranged.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, _same("source", "s") & (F.col("range") == F.col("b")))
        .withColumn("epochs", epochs)
        .withColumn("left", budget - F.col("epochs") * F.col("source_size") - F.col("start") - F.col("own"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.least("size", F.greatest(F.lit(0), "left")))
        .select("id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "r", "epochs")
    )


def mixed_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """df's rows, each as often as the mix takes it, the row at a source's cut whole; the texts are not shuffled.

    A source's last epoch takes the rows up to one random key, so a table of one cut a source decides every row. Only a
    table in which ids occur more than once is written down with row numbers, so that each such row meets its own key.
    """
    sized, several = _keyed(df, key, text, source, seed)
    rows = df.withColumn("__r", _columns(key, text, seed)[0])
    if several is not None:
        numbered = storage.materialise(df.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
        sized, several = _keyed(numbered, key, text, source, seed, F.col("__row"))
        ids = storage.small(several.select(F.col("again").alias("__again")), several.count(), ID_BYTES)
        keys = storage.materialise(sized.join(ids, _same("id", "__again")).select(F.col("row").alias("__own"), F.col("r").alias("__r")), "mix-own")
        once = numbered.join(ids, F.col(f"`{key}`").eqNullSafe(F.col("__again")), "left_anti").withColumn("__r", _columns(key, text, seed)[0])
        rows = once.unionByName(numbered.join(storage.small(keys, keys.count(), KEY_BYTES), F.col("__row") == F.col("__own")).drop("__own"))
    cuts = storage.materialise(
        _take(sized, weights, share, most)
        .groupBy(F.col("source").alias("__cut_source"))
        .agg(F.max("epochs").alias("__epochs"), F.max(F.when(F.col("taken") > F.col("epochs") * F.col("size"), F.col("r"))).alias("__last")),
        "mix-cuts",
    )
    times = F.col("__epochs") + F.when(F.col("__r") <= F.col("__last"), 1).otherwise(0)
    return (
        rows.join(storage.small(cuts, cuts.count(), CUT_BYTES), F.col(f"`{source}`").eqNullSafe(F.col("__cut_source")))
        .withColumn("__times", times.cast("int"))
        .where("__times > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
        .select(*[F.col(f"`{c}`") for c in df.columns])
    )
