"""Injected models and their deterministic offline stand-ins.

A model is a plain callable that workers import or unpickle.  Retries belong to the callable (with_retries), and Spark repeats failed tasks.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
#: (system prompt, user prompt, temperature, most tokens) to the answer.
Completer = Callable[[str, str, float, int], str]
PairScorer = Callable[[Sequence[tuple[str, str]]], Sequence[float]]


def with_retries(call: Callable, tries: int = 3, first_wait: float = 1.0, longest: float = 8.0) -> Callable:
    """call, repeated with doubling waits on any exception."""

    def run(*args):
        wait = first_wait
        for left in range(tries - 1, -1, -1):
            try:
                return call(*args)
            except Exception:
                if not left:
                    raise
                time.sleep(min(wait, longest))
                wait *= 2

    return run


def hashed_embedder(texts: Sequence[str], size: int = 64) -> list[list[float]]:
    """Stand-in: signed counts of hashed words, scaled to length 1 (zero for texts without words)."""
    out = []
    for t in texts:
        v = np.zeros(size)
        for w in t.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % size] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def word_overlap(pairs: Sequence[tuple[str, str]]) -> list[float]:
    """Stand-in: the Jaccard similarity of lower-cased words."""
    sets = [(set(a.lower().split()), set(b.lower().split())) for a, b in pairs]
    return [len(a & b) / len(a | b) if a | b else 0.0 for a, b in sets]


def echo_completer(system: str, user: str, temperature: float = 0.1, most: int = 1024) -> str:
    """Stand-in: the first `most` characters of the user's prompt."""
    return user[:most]


def embed_distinct(df: DataFrame, text: str, model: str, embedder: Embedder = hashed_embedder, cache: DataFrame | None = None) -> DataFrame:
    """df with vector array<float>; each distinct text is embedded once, and not at all if the cache (text, model, vector) has it."""
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)  # noqa: E731  texts meet by their hashes; null counts as empty
    keyed = df.withColumn("_sha", digest(F.col(text)))
    wanted = keyed.groupBy("_sha").agg(F.any_value(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    known = None
    if cache is not None:
        known = cache.filter(F.col("model") == model).select(digest(F.col("text")).alias("_sha"), "vector").dropDuplicates(["_sha"])
        wanted = wanted.join(known.select("_sha"), "_sha", "left_anti")

    @F.arrow_udf("array<float>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([list(map(float, v)) for v in embedder(column.to_pylist())], pa.list_(pa.float32()))

    made = wanted.select("_sha", run("_text").alias("vector"))
    return keyed.join(made if known is None else known.unionByName(made), "_sha").drop("_sha")


def cache_stats(requests: DataFrame, text: str = "text") -> DataFrame:
    """One row: hits, misses, size and hit_rate (0 if unused) of a cache that starts empty."""
    n, distinct = F.count(F.lit(1)), F.count_distinct(text)
    return requests.agg((n - distinct).alias("hits"), distinct.alias("misses"), distinct.alias("size"), F.when(n > 0, F.round((n - distinct) / F.nullif(n, F.lit(0)), 6)).otherwise(0.0).alias("hit_rate"))


def complete(system: Column, user: Column, completer: Completer, temperature: float = 0.1, most: int = 1024) -> Column:
    """The model's answer, trimmed.  Filter rows before: a UDF runs for every row that reaches it, whatever a condition around it says."""

    @F.arrow_udf("string")
    def run(systems: pa.Array, users: pa.Array) -> pa.Array:
        return pa.array([completer(s, u, temperature, most).strip() for s, u in zip(systems.to_pylist(), users.to_pylist(), strict=True)], pa.string())

    return run(system, user)


def pair_scores(question: Column, text: Column, scorer: PairScorer = word_overlap) -> Column:
    @F.arrow_udf("double")
    def run(questions: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([float(x) for x in scorer(list(zip(questions.to_pylist(), texts.to_pylist(), strict=True)))], pa.float64())

    return run(question, text)
