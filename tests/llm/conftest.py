import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from small_rows import ROWS  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    """ROWS with columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for c in ("id", "k", "h", "n", "t", "w", "size", "r", "range", "sig", "rid", "chunk", "row", "print", "key", "label", "held_out", "gram", "grade"):
        df = df.withColumn(c, F.lit(f"other {c}"))
    return df.repartition(3, "source")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id = -1")
