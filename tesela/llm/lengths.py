"""Exact length histograms of encoded documents, and what they answer for every context limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths that share a block of the two-level sums.
BLOCK = 256


def length_histogram(df: DataFrame, length: str = "n_tokens") -> DataFrame:
    """(n_tokens long, n_docs long): how many documents have each encoded length.  Rows with a null length don't count."""
    return df.groupBy(F.col(length).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_tokens").isNotNull())


def context_table(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, as a context limit: what holds for all documents.

    n_tokens: L; n_docs: documents of exactly that length; docs_within and docs_beyond: of at most L, of more than L tokens;
    tokens_within: tokens of the documents that fit; truncated_total: tokens left when every document is cut at L; quantile: the share
    of documents of at most L tokens, so the q-quantile of lengths is the first L whose quantile is at least q.  An empty histogram
    gives an empty table.

    Suffix sums run in two levels (blocks of 256 lengths, then within a block), so no task gets all lengths.
    """
    block = F.floor(F.col("n_tokens") / BLOCK)
    h = histogram.withColumn("_block", block).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    # the blocks' own sums are again dealt to groups, so that each window holds few rows even for very long documents
    sums = h.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t")).withColumn("_group", F.floor(F.col("_block") / BLOCK))
    tops = sums.groupBy("_group").agg(F.sum("_d").alias("_d"), F.sum("_t").alias("_t"))
    # one row for 65,536 lengths: even a document of a billion tokens gives 15,259 rows here
    after = Window.partitionBy(F.lit(0)).orderBy(F.col("_group").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_group", _or0(F.sum("_d").over(after)).alias("_gd"), _or0(F.sum("_t").over(after)).alias("_gt"))
    inside = Window.partitionBy("_group").orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.join(tops, "_group").select("_block", (_or0(F.sum("_d").over(inside)) + F.col("_gd")).alias("_bd"), (_or0(F.sum("_t").over(inside)) + F.col("_gt")).alias("_bt"))
    longer = Window.partitionBy("_block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(offsets, "_block").select(
        "n_tokens", "n_docs",
        (_or0(F.sum("n_docs").over(longer)) + F.col("_bd")).alias("docs_beyond"),
        (_or0(F.sum("_tokens").over(longer)) + F.col("_bt")).alias("_beyond"),
    )
    total = histogram.agg(F.sum("n_docs").alias("_docs"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("_all"))
    out = out.join(F.broadcast(total))  # a single row
    within = F.col("_docs") - F.col("docs_beyond")
    return out.select(
        "n_tokens", "n_docs", within.alias("docs_within"), "docs_beyond",
        (F.col("_all") - F.col("_beyond")).alias("tokens_within"),
        (F.col("_all") - F.col("_beyond") + F.col("docs_beyond") * F.col("n_tokens")).alias("truncated_total"),
        (within / F.col("_docs")).alias("quantile"),
    )


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))
