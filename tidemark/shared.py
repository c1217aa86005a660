"""Tables and folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; where that is unset, one of this machine if Spark runs on it alone."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that all of them see")
    own = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def folder(spark: SparkSession, tag: str) -> str:
    """The name of a new folder in the shared one, deleted by drop_written() or with the tables of a scratch()."""
    path = f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes on leaving the tables that written() has written inside, but for those handed to the function it gives."""
    start, kept = len(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.written_to)
        return df

    try:
        yield keep
    finally:
        inside = _written[start:]
        _written[start:] = [x for x in inside if x in kept]
        _delete(spark, [x for x in inside if x not in kept])


def _delete(spark: SparkSession, paths: list[str]) -> int:
    n = 0
    for path in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def drop_written(spark: SparkSession) -> int:
    """Deletes every folder and table of this process that is still there; call once no result is read any more."""
    paths = _written[:]
    _written.clear()
    return _delete(spark, paths)
