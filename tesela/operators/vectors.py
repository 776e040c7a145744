"""Cosine distances and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.operators.grid import beside
from tesela.sources.stage import give_back

#: Questions in a block; chunks whose distances to a block are computed at once.
QUESTIONS, CHUNKS = 512, 4096
#: Questions of a block whose distances are held at once.
AT_ONCE = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distances(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, distance) for queries (query_id, vector) and chunks (chunk_id, vector): 1 - cosine, 1 where a vector is zero.

    A row for every pair, for rankings that need all of them; nearest() doesn't make them.
    """
    q = queries.select("query_id", F.col("vector").alias("_q"), norm(F.col("vector")).alias("_qn"))
    c = chunks.select("chunk_id", F.col("vector").alias("_c"), norm(F.col("vector")).alias("_cn"))
    cosine = dot(F.col("_q"), F.col("_c")) / F.nullif(F.col("_qn") * F.col("_cn"), F.lit(0.0))
    return c.crossJoin(q).select("query_id", "chunk_id", F.coalesce(1 - cosine, F.lit(1.0)).alias("distance"))


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of unit length in doubles; zero vectors and those of another width become NaN."""
    out = np.full((len(column), width), np.nan)
    sizes = np.asarray(column.value_lengths().fill_null(0))
    good = np.flatnonzero(sizes == width)
    if len(good):
        flat = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[good] = flat.reshape(len(good), width)
    norms = np.sqrt((out**2).sum(1, keepdims=True))
    return out / np.where(norms == 0, np.nan, norms)


def unit_distances(chunks: np.ndarray, questions: np.ndarray) -> np.ndarray:
    """(questions, chunks), rounded; 1 where a vector is zero."""
    d = np.round(1.0 - np.nan_to_num(questions) @ np.nan_to_num(chunks).T, 9)
    d[:, np.isnan(chunks[:, 0])] = 1.0
    d[np.isnan(questions[:, 0])] = 1.0
    return d


def first_places(distances: np.ndarray, keys: np.ndarray, most: int) -> np.ndarray:
    """The places of the `most` smallest distances, ties to the smaller key."""
    if len(keys) <= most:
        return np.arange(len(keys))
    cut = np.partition(distances, most - 1)[most - 1]
    hits = np.flatnonzero(distances <= cut)
    if len(hits) > most:
        at = np.flatnonzero(distances == cut)
        hits = np.concatenate((np.flatnonzero(distances < cut), at[np.argsort(keys[at], kind="stable")]))[:most]
    return hits


def _pack_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's chunks: (chunk_ids, chunk_vectors), lists."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNKS):
            lists = []
            for column in batch.slice(at, CHUNKS).columns:
                column = pa.concat_arrays([column])  # an offset would reach into the list
                lists.append(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column))
            yield pa.RecordBatch.from_arrays(lists, names=["chunk_ids", "chunk_vectors"])


def _nearest(k: int):
    """(query_id, chunk_id, distance) of the k nearest chunks of a block to each question of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk_ids, chunk_vectors, ids, asked = (batch.column(c)[i].values for c in ("chunk_ids", "chunk_vectors", "ids", "vectors"))
                width = max(1, *(n or 0 for n in asked.value_lengths().to_pylist()))
                keys = np.array(chunk_ids.to_pylist(), dtype=object)
                units, questions = unit_rows(chunk_vectors, width), unit_rows(asked, width)
                hits, held = [], []
                for at in range(0, len(questions), AT_ONCE):
                    for x in unit_distances(units, questions[at : at + AT_ONCE]):
                        hits.append(first_places(x, keys, k))
                        held.append(x[hits[-1]])
                q, c = np.repeat(np.arange(len(hits)), [len(h) for h in hits]), np.concatenate(hits)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), chunk_ids.take(pa.array(c)), pa.array(np.concatenate(held))], names=["query_id", "chunk_id", "distance"])
        give_back()

    return run


def nearest(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k nearest chunks of each query: (query_id, chunk_id, distance, rank from 0); ties of the distance, rounded to nine places, to
    the smaller chunk_id.  Vectors that are zero or of another dimension are at distance 1.

    The stated questions meet all chunks in blocks: a block of questions and one of chunks are a row each, their distances one matrix
    product, and of each product only the k first of every question go on.  Questions beyond a bound aren't broadcast (see beside()).
    """
    many, width = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    few = max(1, -(-many // QUESTIONS))
    packed = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(few)).alias("block")).agg(F.collect_list(F.struct("query_id", F.col("vector").cast("array<double>").alias("vector"))).alias("q"))
    packed = packed.select("block", F.col("q.query_id").alias("ids"), F.col("q.vector").alias("vectors"))
    q_type, c_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (chunks, "chunk_id")))
    own = chunks.select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    held = own.mapInArrow(_pack_chunks, f"chunk_ids array<{c_type}>, chunk_vectors array<array<double>>")
    found = beside(held, "chunk_ids", packed, "block", many * (16 + 8 * (width or 0))).mapInArrow(_nearest(k), f"query_id {q_type}, chunk_id {c_type}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    ranked = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
    return ranked.withColumn("rank", F.col("_n") - 1).drop("_n")
