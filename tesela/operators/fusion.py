"""Reciprocal rank fusion, of two rankings and of several questions, and score blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60


def rrf_term(rank: Column) -> Column:
    """What a place (from 0) adds to a chunk's score."""
    return F.lit(1.0) / (RRF_K + rank)


def fuse(bm25: DataFrame, distances: DataFrame, chunk_ids: DataFrame, question_ids: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rrf, distance, bm25_rank, rank) of every chunk for every question, rank from 0.

    bm25: (query_id, chunk_id, score), chunks without a row score 0; distances: (query_id, chunk_id, distance), chunks without a row
    have distance 1 and no vector rank.  BM25 ties go to the smaller chunk_id, ties of the sum to the better BM25 rank.  Rankings are over
    the whole corpus: questions are the unit of parallelism here, and top_fused() and top_fused_groups() are the ways to the first k without
    them.
    """
    every = chunk_ids.select("chunk_id").crossJoin(question_ids.select("query_id"))
    rows = every.join(bm25, ["query_id", "chunk_id"], "left").join(distances, ["query_id", "chunk_id"], "left")
    per = Window.partitionBy("query_id")
    lexical = F.row_number().over(per.orderBy(F.round(F.coalesce("score", F.lit(0.0)), 9).desc(), "chunk_id")) - 1
    semantic = F.row_number().over(per.orderBy(F.round("distance", 9).asc_nulls_last(), "chunk_id")) - 1
    ranked = rows.withColumn("bm25_rank", lexical).withColumn("_v", F.when(F.col("distance").isNotNull(), semantic))
    ranked = ranked.withColumn("rrf", rrf_term(F.col("bm25_rank")) + F.coalesce(rrf_term(F.col("_v")), F.lit(0.0)))
    fused = F.row_number().over(per.orderBy(F.round("rrf", 12).desc(), "bm25_rank")) - 1
    return ranked.select("query_id", "chunk_id", "rrf", F.coalesce("distance", F.lit(1.0)).alias("distance"), "bm25_rank", fused.alias("rank"))


def fuse_questions(ranked: DataFrame, group: str = "group_id", order: str = "query_ord") -> DataFrame:
    """Second fusion over the questions of a group: (group, chunk_id, rrf, distance, first_rank, rank).

    ranked: fuse()'s rows with group and the question's place in it.  The distance is that of the first question listed, and ties of the
    sum go to the better place in that question's ranking.
    """
    summed = ranked.groupBy(group, "chunk_id").agg(
        F.sum(rrf_term(F.col("rank"))).alias("rrf"), F.min_by("distance", order).alias("distance"), F.min_by("rank", order).alias("first_rank")
    )
    place = Window.partitionBy(group).orderBy(F.round("rrf", 12).desc(), "first_rank", "chunk_id")
    return summed.withColumn("rank", F.row_number().over(place) - 1)


def minmax(value: Column, window) -> Column:
    """Scaled to 0..1 within the window; 0.5 where all are equal."""
    lo, hi = F.min(value).over(window), F.max(value).over(window)
    return F.when(hi == lo, 0.5).otherwise((value - lo) / F.nullif(hi - lo, F.lit(0.0)))


def blend(hits: DataFrame, alpha: float | Column, k: int, tie: str = "rank", by: list[str] | None = None) -> DataFrame:
    """hits (query_id, rrf, rerank_score, ...) with blended_score, the k best of each question by place (from 0).

    Both scores are scaled within the question's pool; alpha is clamped to 0..1.  Pools of at most k hits keep their order and get no
    scores (null).  by: columns of settings to compare, as a model and its weight, in which case alpha may be a column: every setting has a
    pool of its own, and the pool is read once for all.
    """
    alpha = F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha)) if isinstance(alpha, Column) else max(0.0, min(1.0, alpha))
    per = Window.partitionBy("query_id", *(by or []))
    pool = F.count(F.lit(1)).over(per)
    mixed = alpha * minmax(F.col("rerank_score"), per) + (1 - alpha) * minmax(F.col("rrf"), per)
    rows = hits.withColumn("_pool", pool).withColumn("_mix", mixed)
    rows = rows.withColumn("blended_score", F.when(F.col("_pool") > k, F.round("_mix", 4))).withColumn("rerank_score", F.when(F.col("_pool") > k, F.round("rerank_score", 4)))
    order = per.orderBy(F.when(F.col("_pool") > k, -F.round("_mix", 9)).otherwise(F.lit(0.0)), tie)
    rows = rows.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k)
    return rows.withColumn("place", F.col("_place") - 1).drop("_pool", "_mix", "_place")
