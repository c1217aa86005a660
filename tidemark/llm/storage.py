"""Shared-folder tables, size-checked broadcasts and package shipping for the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop_written as drop_materialised
from ..shared import scratch, shared_dir
from ..shared import written as materialise

__all__ = ["drop_materialised", "materialise", "scratch", "shared_dir", "ship", "small"]

#: Upper bound of what an operator broadcasts, in bytes of its columns before compression.
BROADCAST_BYTES = 64 << 20

def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its rows fit BROADCAST_BYTES, else df as it is (Spark then shuffles)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that were started without it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="tidemark-zip-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "tidemark_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for d, _, names in os.walk(os.path.join(root, "tidemark")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    sc._tidemark_shipped = True
