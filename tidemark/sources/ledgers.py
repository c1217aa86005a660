"""Append-only JSON-lines ledgers: tolerant, strict and all-or-nothing scans, windows, tails, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

MODES = ("skip", "all_or_nothing", "strict")


def read(spark: SparkSession, path: str, schema: StructType | str, mode: str = "skip") -> DataFrame:
    """Rows of a JSON-lines ledger; a path that is not there gives no rows.

    skip leaves blank and malformed lines out; all_or_nothing gives no rows if one line is malformed; strict fails.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], kind)
        raise
    lines = lines.where(F.trim("value") != "")
    good = F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{")
    if mode == "strict":
        return lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    rows = lines.where(good)
    if mode == "all_or_nothing":
        bad = lines.where(~F.coalesce(good, F.lit(False))).limit(1).select(F.lit(True).alias("bad"))
        rows = rows.join(F.broadcast(bad), how="left_anti", on=F.col("bad"))
    return rows.select(F.from_json("value", kind).alias("r"), "value").select("r.*")


def window(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows with start <= ts <= end; the bounds reach the scan."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def since(df: DataFrame, now: str, days: int, null_ts: str = "drop", ts: str = "ts") -> DataFrame:
    """Rows of the last days; a null ts drops the row, or counts as now."""
    cutoff = F.expr(f"timestamp '{now}' - interval {days} day")
    return df.where((F.coalesce(F.col(ts), F.lit(now).cast("timestamp")) if null_ts == "now" else F.col(ts)) >= cutoff)


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Each key's last row."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)).alias("__last"))
    return last.select("__last.*")


def write_by_time(df: DataFrame, path: str, files: int, ts: str = "ts") -> None:
    """Appends df to path as Parquet files of ranges of time, and to path_files a row a file: name, rows with a time, first and last time."""
    df.repartitionByRange(files, ts).sortWithinPartitions(ts).write.mode("append").parquet(path)
    every = df.sparkSession.read.schema(df.schema).parquet(path).select(F.input_file_name().alias("file"), ts)
    every.groupBy("file").agg(F.count(ts).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).write.mode("overwrite").parquet(f"{path}_files")


def tail_by_time(spark: SparkSession, path: str, schema: str | StructType, n: int, *order: str) -> DataFrame:
    """The last n rows by order, which begins with the time that the ledger is written by; reads the newest files only.

    Of the files that begin latest as many are taken as surely hold n rows; any file that ends at or after the earliest
    beginning of these may hold others as late. Rows without a time come last of all, so they are read only if need be.
    """
    files = spark.read.parquet(f"{path}_files")
    line = W.orderBy(F.desc_nulls_last("first"), "file").rowsBetween(W.unboundedPreceding, 0)  # a row a file
    upto = files.withColumn("upto", F.sum("n").over(line))
    since = upto.where(F.col("upto") - F.col("n") < n).agg(F.min("first").alias("since"), F.max("upto").alias("have"), F.count_if(F.col("first").isNull()).alias("untimed")).first()
    whole = since["since"] is None or since["untimed"] or (since["have"] or 0) < n
    chosen = [r["file"] for r in (files if whole else files.where(F.col("last") >= F.lit(since["since"]))).select("file").collect()]
    rows = spark.read.schema(schema).parquet(*chosen) if chosen else spark.createDataFrame([], schema)
    return tail(rows, n, *order)
