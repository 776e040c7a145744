"""BM25 for many questions at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions.text import tokens
from tesela.sources.stage import give_back, staged

# The formula's constants.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Tokens counted at once.
TOKENS = 1 << 18


@dataclass
class Bm25Index:
    """chunks: (chunk_id, dl, counts: array<struct<term, tf>>); terms: (term, df, idf); stats: one row (n, avgdl, average_idf)."""

    chunks: DataFrame
    terms: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(chunk_id, term, tf, dl), one row for each term of a chunk."""
        return self.chunks.select("chunk_id", "dl", F.explode("counts").alias("c")).select("chunk_id", "c.term", "c.tf", "dl")


def _counted(rows: pa.Array) -> pa.Array:
    """Each row's distinct terms with their numbers, of about TOKENS tokens at once."""
    parts = [_counted_part(rows.slice(lo, hi - lo)) for lo, hi in _slices(rows)]
    out = pa.concat_arrays(parts) if parts else _counted_part(rows)
    give_back()
    return out


def _slices(rows: pa.Array) -> list[tuple[int, int]]:
    """Ranges of rows of about TOKENS tokens each."""
    ends = np.cumsum(np.asarray(rows.value_lengths().fill_null(0), np.int64))
    cuts = np.flatnonzero(np.diff(ends // TOKENS, prepend=0)).tolist()
    return [(lo, hi) for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True) if hi > lo]


def _counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk_id, tokens) as (chunk_id, dl, counts), each slice on its way before the next is counted."""
    for batch in batches:
        ids, rows = batch.columns
        for lo, hi in _slices(rows):
            some = rows.slice(lo, hi - lo)
            dl = np.asarray(some.value_lengths().fill_null(0), np.int64)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(dl), _counted_part(some)], names=["chunk_id", "dl", "counts"])
    give_back()


def _counted_part(rows: pa.Array) -> pa.Array:
    """Each row's distinct terms with their numbers: the terms of a batch are numbered, and equal (row, number) pairs counted at once."""
    sizes = np.asarray(rows.value_lengths().fill_null(0), np.int64)
    coded = rows.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, len(coded.dictionary))
    pairs, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + code, return_counts=True)
    ends = np.searchsorted(pairs, np.arange(len(sizes) + 1) * width)
    entries = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pairs % width)), pa.array(tf, pa.int64())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)


def term_counts(text: Column) -> Column:
    """array<struct<term, tf>> of a text, counted inside the row: no shuffle of its tokens."""
    return F.arrow_udf(_counted, "array<struct<term:string,tf:bigint>>")(tokens(F.coalesce(text, F.lit(""))))


def bm25_index(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> Bm25Index:
    """Term counts by chunk and statistics of a corpus.

    Texts are read once: their counts are staged, and everything else reads these.  Only distinct terms with partial sums are shuffled.
    """
    told = chunks.select(F.col(chunk_id).alias("chunk_id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    kind = told.schema["chunk_id"].dataType.simpleString()
    rows = staged(told.mapInArrow(_counted_rows, f"chunk_id {kind}, dl long, counts array<struct<term:string,tf:bigint>>"))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = rows.select(F.explode("counts.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # totals and averages are single rows
    raw = df.crossJoin(F.broadcast(totals)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    raw = staged(raw)
    average = raw.agg(F.avg("raw").alias("average_idf"))
    terms = raw.crossJoin(F.broadcast(average)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("average_idf")).otherwise(F.col("raw")).alias("idf"))
    return Bm25Index(rows, terms, totals.crossJoin(F.broadcast(average)))


def question_terms(questions: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term, qn): a question's terms with their number."""
    rows = questions.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))


def bm25_scores(index: Bm25Index, terms: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of the chunks that hold a term of the question; all others score 0.

    A chunk's counts meet the asked terms where they lie (those are as many as the questions have; Spark broadcasts them while they are
    few), and all of a chunk's hits are summed in its task before the one shuffle, of a row for each pair of question and chunk.
    """
    asked = terms.join(index.terms, "term").select("query_id", "term", (F.col("qn") * F.col("idf")).alias("gain"))
    hits = index.postings.join(asked, "term").crossJoin(F.broadcast(index.stats.select("avgdl")))
    part = F.col("gain") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
