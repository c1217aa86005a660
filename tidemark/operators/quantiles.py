"""Exact quantiles by distributed selection: no task holds a key's values.

The wanted places of each key (two, if the quantile lies between them) are searched at once. A round cuts the values
still in question, between a low and a high bound, into RANGES ranges (in turn equal ones, and ones of equal ratio of the distance
to the low bound, so that neither clusters nor scales take many rounds), counts them, finds by prefix sums the range
that holds the place, and goes on with that range's smallest and largest value. A few rounds leave one value, or so few
different ones that they are ranked as they are. What travels is a row a key, place and range, or a row a different value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import shared

RANGES, FEW = 1024, 4096
#: Powers of ten below the whole span that ranges of equal ratio tell apart.
DECADES = 300


def exact(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], rank: str = "linear", ranges: int = RANGES, few: int = FEW) -> DataFrame:
    """A row a key with the wanted quantiles of its values that are not null (NaN is left out), null without any.

    rank: 'linear' takes the value at q * (n - 1), on the line between its neighbours; 'floor' and 'even' take the one
    at that place cut down, or rounded half to even.
    """
    spark = df.sparkSession
    names = [f"__k{i}" for i in range(len(keys))]
    with shared.scratch(spark) as keep:
        v = F.col(value).cast("double")
        rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], F.when(~F.isnan(v), v).alias("v"))
        rows = rows.where("v is not null").groupBy(*names, "v").agg(F.count("*").alias("n"))
        rows = shared.written(rows.withColumn("__k", F.xxhash64(F.lit(0), *names)), "quantile-values")
        at = F.array(*[F.struct(F.lit(k).alias("q"), F.lit(float(q)).alias("share")) for k, q in wanted.items()])
        total = rows.groupBy("__k", *names).agg(F.sum("n").alias("all"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("values"))
        place = F.col("share") * (F.col("all") - 1)
        below = F.bround(place) if rank == "even" else F.floor(place)
        places = F.array_distinct(F.array(below.cast("long"), (F.ceil(place) if rank == "linear" else below).cast("long")))
        state = total.select("*", F.explode(at).alias("w")).select("*", "w.*").drop("w").withColumn("part", place - F.floor(place))
        state = state.withColumn("floor", below.cast("long")).withColumn("place", F.explode(places)).withColumn("skip", F.lit(0).cast("long"))
        state = shared.written(state, "quantile-state")
        by_ratio = False
        while (most := state.where("lo < hi").agg(F.max("values")).first()[0] or 0) > few:
            state, by_ratio = shared.written(_narrowed(rows, state, ranges, by_ratio), "quantile-state"), not by_ratio
        found = state.where("lo = hi").withColumn("v", F.col("lo"))
        if most:
            inside = state.where("lo < hi").join(rows.select(F.col("__k").alias("k"), "v", "n"), (F.col("__k") == F.col("k")) & F.col("v").between(F.col("lo"), F.col("hi")))
            upto = F.sum("n").over(W.partitionBy("__k", "q", "place").orderBy("v").rowsBetween(W.unboundedPreceding, 0)) + F.col("skip")
            inside = inside.withColumn("upto", upto).where("place < upto and place >= upto - n")
            found = found.select(*names, "q", "place", "floor", "part", "v").unionByName(inside.select(*names, "q", "place", "floor", "part", "v"))
        low, high = F.max(F.when(F.col("place") == F.col("floor"), F.col("v"))), F.max(F.when(F.col("place") != F.col("floor"), F.col("v")))
        part = F.max("part")
        each = found.groupBy(*names, "q").agg(F.when(high.isNull(), low).otherwise(low * (1 - part) + high * part).alias("v"))
        out = each.groupBy(*names).agg(*[F.max(F.when(F.col("q") == k, F.col("v"))).alias(k) for k in wanted])
        return keep(shared.written(out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], *wanted), "quantiles"))


def _narrowed(rows: DataFrame, state: DataFrame, ranges: int, by_ratio: bool) -> DataFrame:
    """state with the bounds of the range that holds each place; skip: values before it."""
    open_, done = state.where("lo < hi"), state.where("lo >= hi")
    x = rows.select(F.col("__k").alias("k"), "v", "n").join(open_.select("__k", "q", "place", "lo", "hi"), (F.col("k") == F.col("__k")) & F.col("v").between(F.col("lo"), F.col("hi")))
    # halves keep the span finite; monotone in v, so ranges are in order whatever is rounded
    share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    if by_ratio:
        share = F.when(share > 0, F.greatest(1 + F.log10(share) / DECADES, F.lit(0.0))).otherwise(0.0)
    cut = F.least(F.floor(share * ranges), F.lit(ranges - 1))
    counts = x.groupBy("__k", "q", "place", cut.alias("r")).agg(F.sum("n").alias("n"), F.count("*").alias("values"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto = F.sum("n").over(W.partitionBy("__k", "q", "place").orderBy("r").rowsBetween(W.unboundedPreceding, 0))
    counts = counts.withColumn("upto", upto).select("__k", "q", "place", "n", "upto", *[F.col(c).alias(f"new_{c}") for c in ("values", "lo", "hi")])
    next_ = open_.drop("values", "lo", "hi").join(counts, ["__k", "q", "place"]).where("place < upto + skip and place >= upto + skip - n")
    next_ = next_.withColumn("skip", F.col("skip") + F.col("upto") - F.col("n")).drop("n", "upto").withColumnsRenamed({f"new_{c}": c for c in ("values", "lo", "hi")})
    return next_.unionByName(done)


def joined(left: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """left with the cuts of its keys, null keys included."""
    if not keys:
        return left.join(cuts)
    right = cuts.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(right, on, "left").drop(*[f"__{k}" for k in keys])
