"""Connected components of an edge table, by hooking to the smallest neighbour and pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every end of edges (a, b: long); a component's name is its smallest node.

    Each round, every node hooks to its smallest smaller neighbour, chains are shortened until all point to a root,
    and the edges move to the roots; every root with an edge left hooks in the next round, so few rounds suffice.
    """
    with storage.scratch(edges.sparkSession) as keep:
        links = storage.materialise(_larger_first(edges.select("a", "b")), "links")
        labels = None
        while not links.isEmpty():
            with storage.scratch(edges.sparkSession) as keep_round:
                labels, links = (keep_round(x) for x in _round(links, labels))
        return keep(labels) if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component")).where("false")


def _round(links: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(labels, links) after one round."""
    hooks = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    hooks = storage.materialise(hooks, "hooks")
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        longer = storage.materialise(hooks.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "hooks")
        hooks = longer.select("node", "root")
        if longer.where("moved").isEmpty():
            break
    if labels is None:
        labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node"))
    jump = hooks.withColumnRenamed("node", "component")
    labels = storage.materialise(labels.join(jump, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
    a, b = (hooks.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
    moved = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    return labels, storage.materialise(_larger_first(moved), "links")


def _larger_first(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
