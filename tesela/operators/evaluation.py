"""Scores of answers, labels and extractions against expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions import text
from tesela.operators.lexical import Bm25Index, bm25_index
from tesela.operators.querylog import whole
from tesela.sources.stage import staged


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def case_scores(cases: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """cases with tp, fp, fn, precision, recall and f1 of two label arrays."""
    e, p = F.array_distinct(expected), F.array_distinct(predicted)
    tp, fp, fn = F.size(F.array_intersect(e, p)), F.size(F.array_except(p, e)), F.size(F.array_except(e, p))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return cases.withColumns({"tp": tp, "fp": fp, "fn": fn, "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)})


def micro_scores(scored: DataFrame, *groups: str) -> DataFrame:
    """tp, fp, fn and micro precision, recall and f1, to three places."""
    sums = scored.groupBy(*groups).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(*groups, "tp", "fp", "fn", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(ratio(2 * p * r, p + r), 3).alias("f1"))


def keyword_coverage(items: Column, keywords: Column) -> Column:
    """The share of keywords that the items hold, folded; 1 without keywords."""
    joined = text.fold(F.array_join(items, " || "))
    hits = F.filter(keywords, lambda k: F.contains(joined, text.fold(k)))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(F.size(hits) / F.nullif(F.size(keywords), F.lit(0)))


def mean_coverage(cases: DataFrame, case: str, coverage: str) -> DataFrame:
    """The mean over cases of each case's mean coverage."""
    return cases.groupBy(case).agg(F.avg(coverage).alias("_c")).agg(F.round(F.avg("_c"), 3).alias("coverage"))


def answer_scores(cases: DataFrame) -> DataFrame:
    """cases (expected_sources, sources, must_contain, answer, context) with recall, accuracy and faithfulness; null where not applicable.

    recall: whether any expected source was retrieved; accuracy: the share of required phrases in the answer; faithfulness: the share of
    those in the answer that the context holds, too.
    """
    said = F.filter("must_contain", lambda m: text.contains_folded(F.col("answer"), m))
    backed = F.filter(said, lambda m: text.contains_folded(F.col("context"), m))
    return cases.withColumns({
        "recall": F.when(F.size("expected_sources") > 0, F.arrays_overlap("expected_sources", "sources").cast("double")),
        "accuracy": F.when(F.size("must_contain") > 0, F.size(said) / F.nullif(F.size("must_contain"), F.lit(0))),
        "faithfulness": F.when(F.size(said) > 0, F.size(backed) / F.nullif(F.size(said), F.lit(0))),
    })


def evaluation_report(scored: DataFrame, *groups: str) -> DataFrame:
    """n, recall_rate (null counts as a miss), mean accuracy and faithfulness without nulls, warnings, latency p50 and the harness's p95.

    The harness's own p95: the value at 95 % of the count, cut down, one-based, at least the first.  It comes from the number of cases of
    each latency, so no task holds all cases; p50 is Spark's exact percentile, which keeps these numbers, too.
    """
    report = scored.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("recall", F.lit(0.0))), 6).alias("recall_rate"), F.round(F.avg("accuracy"), 6).alias("accuracy"), F.round(F.avg("faithfulness"), 6).alias("faithfulness"),
        F.coalesce(F.sum("n_warnings"), F.lit(0)).cast("long").alias("warnings"), F.count_if(F.col("n_warnings") > 0).alias("with_warnings"),
        whole(F.median("latency_ms")).alias("p50_ms"),
    )
    counts = scored.filter(F.col("latency_ms").isNotNull()).groupBy(*groups, "latency_ms").agg(F.count(F.lit(1)).alias("_c"))
    per = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    upto = F.sum("_c").over(per.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0))
    at = F.greatest(F.lit(1), F.floor(F.sum("_c").over(per) * 0.95))
    reached = counts.withColumn("_reached", upto >= at).filter("_reached").groupBy(*[F.col(g).alias(f"_{g}") for g in groups]).agg(whole(F.min("latency_ms")).alias("p95_ms"))
    if not groups:
        return report.crossJoin(F.broadcast(reached))  # single rows
    return report.join(reached, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups], "left").drop(*[f"_{g}" for g in groups])


def passage_holders(texts: DataFrame, passages: DataFrame, index: Bm25Index | None = None) -> DataFrame:
    """(query_id, chunk_id) of texts (chunk_id, text) that hold a passage (query_id, question) literally; index: that of the texts, if there
    is one.

    A text that holds a passage has all of its words but for the first and the last, which may go on outside, so candidates meet by the
    rarest of the terms of these: an equi-join with the term counts.  Passages without such terms are compared with all texts; empty ones
    are in every text.
    """
    index = bm25_index(texts) if index is None else index
    own = F.regexp_extract_all(F.col("question"), F.lit(text.TOKEN), F.lit(0))
    # what a capital sigma becomes depends on the letters around it, also outside the passage
    inner = F.filter(F.slice(own, 2, F.greatest(F.size(own) - 2, F.lit(0))), lambda w: ~F.contains(w, F.lit("Σ")))
    asked = passages.filter(F.col("question").isNotNull()).withColumn("_inner", F.array_distinct(text.tokens(F.array_join(inner, " "))))
    wanted = asked.select("query_id", F.explode("_inner").alias("term"))
    rarest = staged(wanted.join(index.terms, "term").groupBy("query_id").agg(F.min(F.struct("df", "term"))["term"].alias("term")))
    pairs = index.chunks.select("chunk_id", F.explode("counts.term").alias("term")).join(rarest, "term").select("query_id", "chunk_id")
    short = asked.filter(F.size("_inner") == 0).select("query_id").crossJoin(texts.select("chunk_id"))
    both = staged(pairs.unionByName(short)).join(passages.select("query_id", "question"), "query_id").join(texts.select("chunk_id", "text"), "chunk_id")
    return both.filter(F.contains("text", F.col("question"))).select("query_id", "chunk_id")
