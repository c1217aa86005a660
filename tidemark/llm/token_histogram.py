"""Token counts: the exact histogram of encoded lengths, and what suffix sums over it answer for every context limit.

One row a distinct length: documents and tokens of that length, documents and tokens of at least that length, the
tokens left if every document is cut at that length, the documents that a window of that length holds whole, and
the share of documents at or below it (for quantiles). The histogram is far smaller than the table; its suffix sums
run over ranges of lengths, with the ranges' totals added, so no task holds it whole.

Defined cases: a null text is an empty one, of length 0; repeated rows count one by one; an empty table gives an
empty result; other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import byte_bpe, storage

#: Lengths of one range, in which a window adds up.
RANGE = 4096


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """n_tokens and n_docs of each length that occurs."""
    return lengths.groupBy(F.col(length).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def by_limit(counts: DataFrame) -> DataFrame:
    """The histogram's rows with docs_at_least, tokens_at_least, tokens_if_cut, docs_whole, share_whole for each length."""
    ranged = counts.withColumn("range", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    over = W.orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    all_ = W.partitionBy()
    totals = ranged.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    totals = totals.select("range", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("t"), F.sum("d").over(all_).alias("all_d"), F.sum("t").over(all_).alias("all_t"))
    inside = W.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = (
        ranged.withColumn("docs_in", F.sum("n_docs").over(inside)).withColumn("tokens_in", F.sum("tokens").over(inside))
        .join(totals, "range")
        .withColumn("docs_at_least", F.col("docs_in") + F.col("d")).withColumn("tokens_at_least", F.col("tokens_in") + F.col("t"))
    )
    whole = F.col("all_d") - F.col("docs_at_least") + F.col("n_docs")
    return summed.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_t") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_if_cut"),
        whole.alias("docs_whole"), (whole / F.col("all_d")).alias("share_whole"),
    )


def quantile(limits: DataFrame, q: float) -> int | None:
    """The smallest length that a share q of the documents does not exceed."""
    return limits.where(F.col("share_whole") >= q).agg(F.min("n_tokens")).first()[0]


def tokens_if_cut(limits: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut at limit, whether or not a document has that length."""
    above = limits.where(F.col("n_tokens") >= limit).orderBy("n_tokens").first()
    if above is None:
        return limits.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0))).first()[0]
    return above["tokens_if_cut"] - (above["n_tokens"] - limit) * above["docs_at_least"]


def token_limits(df: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """by_limit of df's texts, encoded by the rank file."""
    counts = histogram(byte_bpe.lengths(df.select(F.lit(0).alias("id"), F.col(f"`{text}`").alias("text")), ranks, pattern, "id"))
    return by_limit(storage.materialise(counts, "histogram"))
