"""From raw documents to token ids: language ID, exact and near deduplication, mixing to target weights, BPE encoding.

Each stage takes what its predecessor kept, as reread Parquet, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm.bpe import encode_checked
from tesela.llm.common import stash
from tesela.llm.curriculum import training_order
from tesela.llm.exact_dedup import drop_copies
from tesela.llm.language_id import identify_languages, is_held_out, learn_languages
from tesela.llm.near_dedup import drop_near_copies
from tesela.llm.queries import VOCABULARY, table

#: Documents of which no language makes up this share go, like those without a letter.
LEAST_SHARE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a letter and a language that makes up 0.4 of their words or more; a null lang gets the prediction.

    Where no document is labelled, only documents without letters go.
    """
    model = learn_languages(docs.filter(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    known = identify_languages(docs, model)
    kept = known.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose texts differ at most in the case of A to Z."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class of near copies."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents of each source up to its target, some twice, others not at all, in training order."""
    return training_order(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids binary, round_trip boolean): token ids of whole texts, and whether decoding restores them."""
    encoded = encode_checked(docs.select("doc_id", "lang", "source", "text"), "text", VOCABULARY)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("bpe_encode", bpe_encode)]

#: SQL has no expression for the language, near-copy and encoding stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
