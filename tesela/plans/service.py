"""A collection with its manifest and query log: index, synchronise, ask, evaluate, watch."""

from __future__ import annotations

import functools
import time
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesela.functions import models
from tesela.functions.text import contains_folded
from tesela.operators import evaluation, fusion, sync
from tesela.plans import retrieval
from tesela.settings import Settings
from tesela.sources.files import PageParser, corpus_files, corpus_pages, document_chunks
from tesela.sources.logstore import LogStore
from tesela.sources.snapshots import SnapshotStore, SourceStore
from tesela.sources.stage import staged
from tesela.streaming.watch import QUIET_SECONDS, FolderWatch

CHUNKS = "chunk_id string, source string, page int, chunk_index int, text string, extraction string, section_hint string, is_table boolean, vector array<float>"


class Service:
    """Everything under one folder of a shared store; models are injected."""

    def __init__(self, spark: SparkSession, folder: str, corpus: str, settings: Settings | None = None, embedder: models.Embedder = models.hashed_embedder, completer: models.Completer = models.echo_completer,
                 scorer: models.PairScorer = models.word_overlap, parser: PageParser | None = None):
        self.spark, self.corpus, self.settings = spark, corpus, settings or Settings.from_env()
        self.embedder, self.completer, self.scorer, self.parser = embedder, completer, scorer, parser
        folder = folder.rstrip("/")
        self.collection = SourceStore(spark, f"{folder}/{self.settings.collection_name}")
        self.manifest, self.log = SnapshotStore(spark, f"{folder}/manifest"), LogStore(spark, f"{folder}/log")

    def _index(self, files: DataFrame) -> DataFrame:
        return retrieval.index_files(files, self.settings, self.embedder, self.parser)

    def index(self) -> dict[str, int | float]:
        """Index the whole corpus anew, and rewrite the manifest.  Counts of pages and chunks, and seconds."""
        began, files = time.monotonic(), corpus_files(self.spark, self.corpus)
        self.collection.write(self._index(files))
        stored = self.collection.read()
        self.manifest.write(sync.rebuilt_manifest(stored, files.select("source", "sha256")))
        return {"pages": corpus_pages(files, self.parser).count(), "chunks": stored.count(), "elapsed_s": round(time.monotonic() - began, 1)}

    def sync(self) -> dict[str, int]:
        """Index what changed since the manifest; see operators.sync."""
        return sync.sync(self.collection, self.manifest, corpus_files(self.spark, self.corpus), self._index, CHUNKS)

    def state(self) -> DataFrame:
        """What a sync would do."""
        return sync.sync_state(self.manifest.read(sync.MANIFEST), corpus_files(self.spark, self.corpus).select("source", "sha256"))

    def document(self, source: str) -> DataFrame:
        """A document's chunks, from its bucket; its raw text if it isn't indexed."""
        return document_chunks(self.collection.read_sources([source], CHUNKS), corpus_files(self.spark, self.corpus), source)

    def ask(self, questions: DataFrame, top_k: int | None = None) -> DataFrame:
        """Answer questions (query_id string, question), after the log is purged, and log them.

        latency_ms of a logged row is the batch's time for retrieval and generation, divided by its questions.
        """
        self.log.purge(F.current_timestamp() - F.make_dt_interval(F.lit(self.settings.log_retention_days)))
        began = time.monotonic()
        hits = retrieval.retrieve(self.collection.read(CHUNKS), questions, self.settings, self.embedder, self.completer, self.scorer, top_k)
        answers = staged(retrieval.answer(questions, hits, self.completer))
        n = max(1, answers.count())
        each = int((time.monotonic() - began) * 1000 / n)
        rows = answers.select(
            F.current_timestamp().alias("ts"), "question", "answer", "sources", F.lit(each).cast("long").alias("latency_ms"), F.lit(self.settings.llm_model).alias("llm_model"), F.lit(self.settings.embedding_model).alias("embedding_model"), "warnings"
        )
        self.log.append(rows)
        return answers

    def _scored(self, cases: DataFrame, asked: DataFrame, hits: DataFrame, completer: models.Completer) -> DataFrame:
        """cases' scores for asked questions (query_id, question, id, ...) with their hits."""
        answers = retrieval.answer(asked.select("query_id", "question"), hits, completer)
        contexts = retrieval.contexts(hits).select(F.col("group_id").alias("query_id"), "context")
        rows = asked.drop("question").join(answers, "query_id").join(contexts, "query_id", "left").join(cases.drop("question"), "id")
        none = F.array().cast("array<string>")
        named = rows.withColumns({
            "expected_sources": F.coalesce("expected_sources", none), "must_contain": F.coalesce("must_contain", none), "context": F.coalesce("context", F.lit("")),
            "sources": F.coalesce(F.array_sort(F.array_distinct(F.transform("sources", lambda x: x.source))), none), "n_warnings": F.size("warnings"),
        })
        missing = F.filter("must_contain", lambda m: ~contains_folded(F.col("answer"), m))
        return evaluation.answer_scores(named).withColumn("missing_in_answer", missing)

    def evaluate(self, cases: DataFrame, top_k: int | None = None) -> DataFrame:
        """The cases (sources.cases.QUESTIONS) answered as one batch, not logged: id, level, question, answer, sources, warnings, latency_ms (the
        batch's time divided by its cases), recall, accuracy, faithfulness, n_warnings, missing_in_answer.  evaluation_report() sums them up."""
        began = time.monotonic()
        asked = cases.select(F.col("id").alias("query_id"), "question", "id")
        hits = staged(retrieval.retrieve(self.collection.read(CHUNKS), asked.select("query_id", "question"), self.settings, self.embedder, self.completer, self.scorer, top_k))
        scored = staged(self._scored(cases, asked, hits, self.completer))
        each = int((time.monotonic() - began) * 1000 / max(1, scored.count()))
        return scored.withColumn("latency_ms", F.lit(each).cast("long")).select("id", "level", "question", "answer", "sources", "warnings", "latency_ms", "recall", "accuracy", "faithfulness", "n_warnings", "missing_in_answer")

    def compare(self, cases: DataFrame, completers: dict[str, models.Completer], alphas: Sequence[float]) -> DataFrame:
        """A report row for each model and blending weight (model, alpha, n, recall_rate, ...); latencies are not told apart.

        The pool of each question is found and scored once; every weight is a row of it, and every model answers all of them.
        """
        k = self.settings.k(None)
        size = max(k, self.settings.reranker_pool_size)
        asked = cases.select(F.col("id").alias("query_id"), "question")
        plain = replace(self.settings, reranker_enabled=False)
        pool = retrieval.retrieve(self.collection.read(CHUNKS), asked, plain, self.embedder, self.completer, self.scorer, size).drop("rerank_score", "blended_score")
        pool = pool.withColumnRenamed("group_id", "query_id").withColumnRenamed("place", "rank").join(asked, "query_id")
        pool = staged(pool.withColumn("rerank_score", models.pair_scores(F.col("question"), F.col("text"), self.scorer)))
        settings = F.explode(F.array(*map(F.lit, alphas)))
        hits = fusion.blend(pool.withColumn("alpha", settings), F.col("alpha"), k, by=["alpha"])
        key = lambda: F.concat(F.col("alpha").cast("string"), F.lit("/"), F.col("query_id"))
        hits = staged(hits.select(key().alias("group_id"), "place", "source", "page", "section_hint", "text", "distance"))
        keyed = asked.withColumn("alpha", settings).select(key().alias("query_id"), "question", F.col("query_id").alias("id"), "alpha")
        scored = [self._scored(cases, keyed, hits, completer).withColumn("model", F.lit(name)) for name, completer in sorted(completers.items())]
        rows = functools.reduce(DataFrame.unionByName, scored).withColumn("latency_ms", F.lit(0).cast("long"))
        return evaluation.evaluation_report(rows, "model", "alpha").drop("p50_ms", "p95_ms")

    def watch(self, checkpoint: str, quiet: float = QUIET_SECONDS) -> StreamingQuery:
        """Synchronise now, and once for each burst of changes of the corpus from here on."""
        return FolderWatch(self.spark, self.corpus, lambda reason: self.sync()).start(checkpoint, quiet)
