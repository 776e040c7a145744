"""Indexing and answering as plans over many documents and many questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions import models, text
from tesela.operators import blocks, fusion, lexical
from tesela.operators.chunks import chunk_pages
from tesela.operators.topfused import top_fused, top_fused_groups
from tesela.operators.verify import with_warnings
from tesela.plans.prompts import DECOMPOSE, answer_prompt
from tesela.settings import Settings
from tesela.sources.files import PageParser, corpus_pages
from tesela.sources.stage import staged

NOT_FOUND = "No encuentro esta informacion en los documentos indexados."


def index_files(files: DataFrame, settings: Settings, embedder: models.Embedder = models.hashed_embedder, parser: PageParser | None = None) -> DataFrame:
    """Files to embedded chunks."""
    chunks = chunk_pages(corpus_pages(files, parser), settings.chunk_size, settings.chunk_overlap)
    return models.embed_distinct(chunks, "text", settings.embedding_model, embedder)


def sub_questions(questions: DataFrame, completer: models.Completer) -> DataFrame:
    """questions (query_id, question) with subs, array<string>: compound ones as a model divides them, at most three; all others, and
    those whose answer holds no question, themselves.  Only compound rows reach the model."""
    compound = text.is_compound(F.col("question"))
    asked = questions.filter(compound).withColumn("_raw", models.complete(F.lit(DECOMPOSE), F.col("question"), completer, 0.0, 256))
    listed = F.from_json(F.regexp_extract("_raw", r"(?s)\[.*\]", 0), "array<string>")
    good = F.slice(F.filter(F.transform(listed, text.trim_all), lambda s: text.looks_like_question(s)), 1, 3)
    divided = asked.select(*questions.columns, F.when(F.size(good) > 0, good).otherwise(F.array("question")).alias("subs"))
    return divided.unionByName(questions.filter(~F.coalesce(compound, F.lit(False))).withColumn("subs", F.array("question")))


def asked_questions(divided: DataFrame) -> DataFrame:
    """(group_id, query_ord, query_id, question): a lone sub-question replaces the question, several follow it."""
    listed = F.when(F.size("subs") == 1, F.col("subs")).otherwise(F.concat(F.array("question"), F.col("subs")))
    rows = divided.select(F.col("query_id").alias("group_id"), F.posexplode(listed).alias("query_ord", "question"))
    return rows.withColumn("query_id", F.concat_ws("/", "group_id", "query_ord"))


def retrieve(collection: DataFrame, questions: DataFrame, settings: Settings, embedder: models.Embedder = models.hashed_embedder, completer: models.Completer = models.echo_completer,
             scorer: models.PairScorer = models.word_overlap, top_k: int | None = None) -> DataFrame:
    """(group_id, place, chunk_id, source, page, section_hint, text, rrf, distance, rerank_score, blended_score), the k best chunks of
    each question (query_id string, question), place from 0."""
    k = settings.k(top_k)
    size = max(k, settings.reranker_pool_size) if settings.reranker_enabled else k
    asked = asked_questions(sub_questions(questions, completer))
    asked = asked.join(asked.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n")), "group_id")
    index = lexical.bm25_index(collection)
    embedded = models.embed_distinct(asked, "question", settings.embedding_model, embedder).select("query_id", "vector")
    weighed = blocks.weighted_questions(lexical.question_terms(asked, text="question"), index, embedded, asked)
    weighed = staged(weighed.join(asked.select("query_id", "group_id", "query_ord", "_n"), "query_id"))
    held = blocks.corpus_blocks(index, collection.filter(F.col("vector").isNotNull()).select("chunk_id", "vector"))
    columns = ["group_id", "chunk_id", "rrf", "distance", "rank"]
    # a question on its own keeps its fused score; several are fused once more
    alone = top_fused(held, weighed.filter("_n = 1"), size)
    pool = alone.join(weighed.select("query_id", "group_id"), "query_id").select(*columns)
    several = weighed.filter("_n > 1")
    if not several.isEmpty():
        pool = pool.unionByName(top_fused_groups(held, several, size).select(*columns))
    pool = pool.withColumnRenamed("group_id", "query_id")
    hits = pool.join(collection.select("chunk_id", "source", "page", "section_hint", "text"), "chunk_id")
    if settings.reranker_enabled:
        named = hits.join(questions.select("query_id", "question"), "query_id")
        hits = fusion.blend(named.withColumn("rerank_score", models.pair_scores(F.col("question"), F.col("text"), scorer)), settings.reranker_alpha, k)
    else:
        hits = hits.withColumns({"place": F.col("rank"), "rerank_score": F.lit(None).cast("double"), "blended_score": F.lit(None).cast("double")})
    return hits.select(F.col("query_id").alias("group_id"), "place", "chunk_id", "source", "page", "section_hint", "text", F.round("rrf", 6).alias("rrf"), "distance", "rerank_score", "blended_score")


def contexts(hits: DataFrame) -> DataFrame:
    """(group_id, context as shown to the model, evidence: the bare texts, sources) of each question with hits."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "source", "page", F.coalesce("section_hint", F.lit("")).alias("section_hint"), "text", F.round("distance", 4).alias("distance"))))
    rows = hits.groupBy("group_id").agg(ordered.alias("_hits"))
    cited: Callable[[Column], Column] = lambda h: F.struct(h.source.alias("source"), h.page.alias("page"), h.section_hint.alias("section_hint"), h.distance.alias("distance"))
    return rows.select("group_id", text.format_context(F.col("_hits")).alias("context"), F.array_join(F.transform("_hits", lambda h: h.text), "\n\n").alias("evidence"), F.transform("_hits", cited).alias("sources"))


def answer(questions: DataFrame, hits: DataFrame, completer: models.Completer) -> DataFrame:
    """(query_id, question, answer, sources, warnings); a question without hits gets a fixed answer, and the model isn't asked."""
    rows = questions.join(contexts(hits).withColumnRenamed("group_id", "query_id"), "query_id", "left")
    system, user = answer_prompt(F.col("question"), F.col("context"))
    found = rows.filter(F.col("context").isNotNull()).withColumn("answer", models.complete(system, user, completer))
    lost = rows.filter(F.col("context").isNull()).withColumn("answer", F.lit(NOT_FOUND))
    both = found.unionByName(lost).withColumn("evidence", F.coalesce("evidence", F.lit("")))
    return with_warnings(both, "query_id", "answer", "evidence").select("query_id", "question", "answer", "sources", "warnings")


