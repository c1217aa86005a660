"""The tail of a ledger written by time reads few files and gives the rows of a whole read."""

import datetime
import random

import pytest

from tidemark.sources import ledgers

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp"


@pytest.mark.parametrize(("n", "most"), [(1, 1), (20, 2), (150, 4), (10_000, 99)])
def test_tail_by_time(spark, tmp_path, n, most):
    rng, path = random.Random(2), f"file://{tmp_path}/ledger"
    rows = [(i, T0 + datetime.timedelta(seconds=rng.randrange(100_000))) for i in range(1000)]
    ledgers.write_by_time(spark.createDataFrame(rows, SCHEMA), path, 20)
    got = ledgers.tail_by_time(spark, path, SCHEMA, n, "ts", "id")
    assert [r["id"] for r in got.collect()] == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)[:n]]
    assert len(got.inputFiles()) <= most


def test_appends_overlap_and_ties(spark, tmp_path):
    """Later appends hold earlier rows, too, and many rows share the last time."""
    path, rows = f"file://{tmp_path}/ledger", []
    for part in range(3):
        more = [(part * 1000 + i, T0 + datetime.timedelta(seconds=min(i * 7 + part * 100, 1500))) for i in range(300)]
        ledgers.write_by_time(spark.createDataFrame(more, SCHEMA), path, 8)
        rows += more
    for n in (5, 400):
        got = ledgers.tail_by_time(spark, path, SCHEMA, n, "ts", "id")
        assert [r["id"] for r in got.collect()] == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)[:n]]


def test_rows_without_a_time(spark, tmp_path):
    path, rows = f"file://{tmp_path}/ledger", [(1, T0), (2, None), (3, T0 + datetime.timedelta(days=1))]
    ledgers.write_by_time(spark.createDataFrame(rows, SCHEMA), path, 2)
    assert [r["id"] for r in ledgers.tail_by_time(spark, path, SCHEMA, 3, "ts", "id").collect()] == [3, 1, 2]
    assert [r["id"] for r in ledgers.tail_by_time(spark, path, SCHEMA, 1, "ts", "id").collect()] == [3]
    mixed = [(i, T0 + datetime.timedelta(days=30) if i == 0 else None) for i in range(10)] + [(100 + i, T0 + datetime.timedelta(seconds=i)) for i in range(10)]
    ledgers.write_by_time(spark.createDataFrame(mixed, SCHEMA), f"{path}2", 1)
    assert [r["id"] for r in ledgers.tail_by_time(spark, f"{path}2", SCHEMA, 4, "ts", "id").collect()] == [0, 109, 108, 107]
