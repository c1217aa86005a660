"""Writers: appends, validated signals, snapshots, CSV, idempotent appends, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("ts", "symbol", "direction", "confidence", "price", "source", "model_version")


def append_json(df: DataFrame, path: str, now: str | None = None) -> None:
    """Appends rows as JSON lines through Spark's file commit; rows without a time get `now`."""
    if now and not {"ts", "timestamp"} & set(df.columns):
        df = df.withColumn("timestamp", F.lit(now))
    df.write.mode("append").json(path)


def valid_signals(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals in normal form with a deterministic id, rows that lack a required value or whose number is none)."""
    for c in REQUIRED:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    n = raw.withColumns({"symbol": F.upper(F.trim("symbol")), "direction": F.lower(F.trim("direction")), "confidence": F.col("confidence").cast("string").try_cast("double"), "price": F.col("price").cast("string").try_cast("double")})
    bad = F.lit(False)
    for c in REQUIRED:
        bad = bad | F.col(c).isNull()
    made = F.concat_ws("_", F.lit("sig"), F.col("ts").cast("string"), "symbol", "direction")
    good = n.where(~bad).withColumn("id", F.coalesce("id", made) if "id" in n.columns else made)
    return good, n.where(bad)


def snapshot(df: DataFrame, path: str) -> None:
    """Replaces what is at path."""
    df.write.mode("overwrite").parquet(path)


def merged(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """old with the rows of changes in place of those with equal key."""
    return old.join(changes.select(key), key, "left_anti").unionByName(changes)


def append_new(new: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys target lacks, one each."""
    return new.dropDuplicates(keys).join(target.select(*keys).distinct(), keys, "left_anti")


def export_csv(df: DataFrame, path: str, columns: list[str], where=None) -> None:
    (df if where is None else df.where(where)).select(*columns).write.mode("overwrite").option("header", True).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size and sha256 of each file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
