"""A corpus as blocks of chunks that answer blocks of questions.

A block holds consecutive chunks in the order of their ids: postings by term, the greatest gain of each term, and the chunks' vectors.  A chunk's number is its place in that order, so ties by id are ties by number.  Questions are a stated set, packed into
blocks too; what a task returns grows with them and with k, not with the chunks that match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesela.operators.grid import beside
from tesela.operators.lexical import B, K1, Bm25Index
from tesela.operators.vectors import unit_distances, unit_rows
from tesela.sources.stage import give_back, staged

#: Chunks in a block, questions in a block.
CHUNKS, QUESTIONS = 2048, 256
#: Blocks that a first threshold is taken from; blocks that each question visits first.
SAMPLE, FIRST = 16, 2
#: Blocks that are open at once.
OPEN = 6
#: A sum of gains may differ by this from the sum of their bounds, and scores are compared after rounding.
SLACK = 2e-9

POSTINGS = "terms array<string>, tops binary, starts binary, places binary, tfs binary, norms binary"


@dataclass
class Blocks:
    """frame: (base long, chunk_ids, terms, tops, starts, places, tfs, norms, vectors), a row a block; base: the number of its first chunk."""

    frame: DataFrame
    chunks: int
    blocks: int

    @property
    def chunk_type(self) -> str:
        return self.frame.schema["chunk_ids"].dataType.elementType.simpleString()

    def sample(self, many: int = SAMPLE) -> DataFrame:
        """About so many blocks, the first among them, as chunks of one score are ordered by their numbers; larger samples hold smaller ones."""
        share = F.lit(int((1 << 30) * min(1.0, many / max(1, self.blocks))))
        return self.frame.filter((F.col("base") == 0) | (F.pmod(F.xxhash64("base"), F.lit(1 << 30)) < share))


def gain(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a chunk's score."""
    return tf * (K1 + 1) / (tf + norm)


def _packed(batch: pa.Table, at: int, average: float) -> pa.RecordBatch:
    rows = batch.combine_chunks()
    chunk_ids, dl, words, tf, vectors = (rows.column(c).combine_chunks() for c in ("chunk_id", "dl", "words", "tf", "vector"))
    terms = pc.split_pattern(words, " ")
    sizes = np.asarray(terms.value_lengths().fill_null(0), np.int64)
    coded = terms.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(codes, kind="stable")
    owner, tfs = owner[order], tf.flatten().to_numpy(zero_copy_only=False).astype(np.float64)[order]
    norms = K1 * (1 - B + B * dl.to_numpy(zero_copy_only=False).astype(np.float64) / (average or 1.0))
    starts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    gains = gain(tfs, norms[owner])
    tops = np.maximum.reduceat(gains, starts[:-1]) if len(gains) else gains
    binary = [pa.array([x.tobytes()], pa.binary()) for x in (tops.astype("<f8"), starts.astype("<i4"), owner.astype("<u2"), tfs.astype("<i4"), norms.astype("<f8"))]
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    return pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([at], pa.int64()), one(chunk_ids), one(coded.dictionary), *binary, one(vectors)],
        names=["part", "at", "chunk_ids", "terms", "tops", "starts", "places", "tfs", "norms", "vectors"],
    )


def _attached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by chunk_id, a vector's before its chunks', as chunks with their vectors."""
    kept: list[pa.RecordBatch] = []
    for batch in (b.slice(at, CHUNKS) for b in batches for at in range(0, b.num_rows, CHUNKS)):
        rows = pa.Table.from_batches([*kept, batch]).combine_chunks()
        ids, vectors = (rows.column(c).combine_chunks() for c in ("chunk_id", "vector"))
        is_chunk = rows.column("is_chunk").to_numpy()
        last = np.maximum.accumulate(np.where(is_chunk, -1, np.arange(len(ids))))
        at = np.flatnonzero(is_chunk)
        own = pa.array(last[at], mask=last[at] < 0)
        same = pc.fill_null(pc.equal(ids.take(own), ids.take(pa.array(at))), False)
        attached = vectors.take(pc.if_else(same, own, pa.scalar(None, pa.int64())))
        if len(at):
            yield from rows.take(pa.array(at)).drop(["vector", "is_chunk"]).append_column("vector", attached).combine_chunks().to_batches()
        kept = rows.slice(int(last[-1]), 1).to_batches() if len(last) and last[-1] >= 0 else []


def _pack(average: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = 0
        for batch in _attached(batches):
            while batch.num_rows:
                some = min(batch.num_rows, size - sum(x.num_rows for x in held))
                held.append(batch.slice(0, some))
                batch = batch.slice(some)
                if sum(x.num_rows for x in held) == size:
                    yield _packed(pa.Table.from_batches(held), at, average)
                    at, held = at + size, []
        if held:
            yield _packed(pa.Table.from_batches(held), at, average)
        held.clear()
        give_back()

    return run


def corpus_blocks(index: Bm25Index, vectors: DataFrame | None = None, size: int = CHUNKS) -> Blocks:
    """The blocks of an indexed corpus; vectors: (chunk_id, vector), of which those of other chunks are left out; of several vectors of one
    chunk, one counts.

    Chunks and vectors are dealt by ranges of their ids, a chunk's terms as one string, in one shuffle; a task numbers its own, and the numbers before it come from
    one sum for each task.
    """
    spark, rows = index.chunks.sparkSession, index.chunks
    average = index.stats.select("avgdl").first()[0]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = F.when(F.size("counts") > 0, F.array_join("counts.term", " ")).alias("words")
    slim = rows.select("chunk_id", "dl", words, F.transform("counts", lambda c: c.tf.cast("int")).alias("tf"), F.lit(None).cast("array<double>").alias("vector"), F.lit(True).alias("is_chunk"))
    if vectors is not None:
        slim = slim.unionByName(vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector"), F.lit(False).alias("is_chunk")), allowMissingColumns=True)
    dealt = slim.repartitionByRange(parts, "chunk_id").sortWithinPartitions("chunk_id", "is_chunk")
    kind = rows.schema["chunk_id"].dataType.simpleString()
    packed = staged(dealt.mapInArrow(_pack(average or 0.0, size), f"part int, at long, chunk_ids array<{kind}>, {POSTINGS}, vectors array<array<double>>"))
    # a row a task
    sizes = {r["part"]: r for r in packed.groupBy("part").agg(F.max(F.col("at") + F.size("chunk_ids")).alias("n"), F.count(F.lit(1)).alias("blocks")).collect()}
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]["n"]
    offsets = spark.createDataFrame(before, "part int, _before long")
    frame = packed.join(F.broadcast(offsets), "part").withColumn("base", F.col("_before") + F.col("at")).drop("part", "at", "_before")
    return Blocks(frame, total, sum(r["blocks"] for r in sizes.values()))


def weighted_questions(terms: DataFrame, index: Bm25Index, vectors: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(query_id, terms array<struct<term, gain>>, vector) of questions: their terms (query_id, term, qn), weighed by the corpus; their
    vectors (query_id, vector); ids: (query_id) of questions that may have neither."""
    gains = terms.join(index.terms, "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", (F.col("qn") * F.col("idf")).alias("gain")))).alias("terms"))
    names = terms.select("query_id")
    for more in (vectors, ids):
        names = names.union(more.select("query_id")) if more is not None else names
    rows = names.distinct().join(gains, "query_id", "left")
    rows = rows.join(vectors.select("query_id", F.col("vector").cast("array<double>").alias("vector")), "query_id", "left") if vectors is not None else rows.withColumn("vector", F.lit(None).cast("array<double>"))
    return rows.select("query_id", F.coalesce("terms", F.array().cast("array<struct<term:string,gain:double>>")).alias("terms"), "vector")


def meet(blocks: DataFrame, questions: DataFrame) -> DataFrame:
    """Each block beside each block of questions (q_block, asked: array of the questions' rows).

    Few go to all workers, more meet the blocks by shuffles (see beside()).
    """
    size = F.lit(16) + 24 * F.size("terms") + 8 * F.coalesce(F.array_size("vector"), F.lit(0))
    for c in (c for c in questions.columns if c not in ("query_id", "terms", "vector")):
        size = size + (24 * F.coalesce(F.array_size(c), F.lit(0)) if questions.schema[c].dataType.typeName() == "array" else F.lit(8))
    many, weight = questions.agg(F.count(F.lit(1)), F.sum(size)).first()
    few = max(1, -(-many // QUESTIONS))
    packed = questions.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(few)).alias("q_block")).agg(F.collect_list(F.struct(*questions.columns)).alias("asked"))
    return beside(blocks, "base", packed, "q_block", weight or 0)


class Asked:
    """A block of questions, opened."""

    def __init__(self, rows: pa.StructArray):
        self.rows = rows
        self.ids = rows.field("query_id")
        self.keys = self.ids.to_pylist()
        terms = rows.field("terms")
        sizes = np.asarray(terms.value_lengths().fill_null(0), np.int64)
        self.ends = np.concatenate(([0], np.cumsum(sizes)))
        entries = terms.flatten()
        coded = entries.field("term").dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.gains = entries.field("gain").to_numpy(zero_copy_only=False)
        vectors = rows.field("vector")
        self.width = max(1, *(n or 0 for n in vectors.value_lengths().to_pylist())) if len(rows) else 1
        self.known = vectors.is_valid().to_numpy(zero_copy_only=False)
        self.vectors = unit_rows(vectors, self.width)

    def column(self, name: str, default: float) -> np.ndarray:
        return self.rows.field(name).fill_null(default).to_numpy(zero_copy_only=False)


class Block:
    """A block of chunks beside a block of questions."""

    def __init__(self, batch: pa.RecordBatch, i: int, asked: Asked):
        self.batch, self.i, self.asked = batch, i, asked
        self.tops = self._numbers("tops", "<f8")
        # where each of the questions' terms stands among the block's
        at = pc.index_in(asked.words, value_set=batch.column("terms")[i].values)
        found = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = found[asked.codes] if len(asked.codes) else np.zeros(0, np.int64)
        self.postings: tuple[np.ndarray, ...] | None = None

    def _numbers(self, name: str, kind: str) -> np.ndarray:
        return np.frombuffer(self.batch.column(name)[self.i].as_buffer(), kind)

    def bounds(self) -> np.ndarray:
        """What the score of a chunk can be at most, for each question."""
        most = np.maximum(self.asked.gains, 0.0) * np.where(self.at >= 0, self.tops[self.at] if len(self.tops) else 0.0, 0.0)
        total = np.concatenate(([0.0], np.cumsum(most)))
        return total[self.asked.ends[1:]] - total[self.asked.ends[:-1]]

    def chunk_ids(self) -> pa.Array:
        return self.batch.column("chunk_ids")[self.i].values

    def numbers(self) -> np.ndarray:
        return self.batch.column("base")[self.i].as_py() + np.arange(len(self.chunk_ids()))

    def scores(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(rounded scores, whether a chunk holds a term) of the block's chunks."""
        if self.postings is None:
            places = self._numbers("places", "<u2")
            self.postings = (self._numbers("starts", "<i4"), places, gain(self._numbers("tfs", "<i4").astype(np.float64), self._numbers("norms", "<f8")[places]))
        starts, places, gains = self.postings
        n = len(self.chunk_ids())
        out, held = np.zeros(n), np.zeros(n, bool)
        for j in range(self.asked.ends[q], self.asked.ends[q + 1]):
            if (t := self.at[j]) >= 0:
                lo, hi = starts[t], starts[t + 1]
                out[places[lo:hi]] += self.asked.gains[j] * gains[lo:hi]  # a term meets a chunk once
                held[places[lo:hi]] = True
        return np.round(out, 9), held

    def distances(self) -> np.ndarray:
        """(questions, chunks) rounded distances; NaN where the chunk or the question has no vector."""
        vectors = self.batch.column("vectors")[self.i].values
        d = unit_distances(unit_rows(vectors, self.asked.width), self.asked.vectors)
        d[:, ~vectors.is_valid().to_numpy(zero_copy_only=False)] = np.nan
        d[~self.asked.known] = np.nan
        return d


def opened(batch: pa.RecordBatch, cache: dict[int, Asked]) -> Iterator[Block]:
    """The rows of a batch as blocks; blocks of questions are opened once a task."""
    for i in range(batch.num_rows):
        number = batch.column("q_block")[i].as_py()
        if number not in cache:
            asked = batch.column("asked")[i].values
            # copied, as a part of the batch would keep all of it
            cache[number] = Asked(asked.take(pa.array(np.arange(len(asked)))))
        yield Block(batch, i, cache[number])


class Best:
    """The k best of a question so far, by (key, number) ascending, with some columns beside."""

    def __init__(self, k: int):
        self.k, self.keys, self.numbers, self.rest = k, np.zeros(0), np.zeros(0, np.int64), None

    def add(self, keys: np.ndarray, numbers: np.ndarray, rest: list[pa.Array]) -> None:
        keys, numbers = np.concatenate((self.keys, keys)), np.concatenate((self.numbers, numbers))
        rest = rest if self.rest is None else [pa.concat_arrays(x) for x in zip(self.rest, rest, strict=True)]
        order = np.lexsort((numbers, keys))[: self.k]
        self.keys, self.numbers, self.rest = keys[order], numbers[order], [x.take(pa.array(order)) for x in rest]

    @property
    def worst(self) -> float:
        return float(self.keys[-1]) if len(self.keys) == self.k else np.inf


def firsts(keys: np.ndarray, k: int, among: np.ndarray | None = None) -> np.ndarray:
    """The places of the k smallest keys, ties to the smaller place; among: places to choose from."""
    among = np.arange(len(keys)) if among is None else among
    if len(among) <= k:
        return among
    own = keys[among]
    cut = np.partition(own, k - 1)[k - 1]
    sure, tied = among[own < cut], among[own == cut]
    return np.concatenate((sure, tied[: k - len(sure)]))


def _scored(k: int, kind: str):
    """(query_id, chunk_id, number, score): a task's k best of each question among chunks that hold a term; blocks are visited by their
    bounds, and left out once k better ones are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, Asked] = {}
        best: dict = {}
        for batch in batches:
            for asked, rows in _few(batch, cache):
                bounds = np.array([b.bounds() for b in rows])
                least = asked.column("least", -np.inf) if "least" in [f.name for f in asked.rows.type] else np.full(len(asked.keys), -np.inf)
                for q, key in enumerate(asked.keys):
                    mine = best.setdefault(key, Best(k))
                    for r in np.argsort(-bounds[:, q], kind="stable"):
                        if bounds[r, q] + SLACK < max(least[q], -mine.worst):
                            break
                        score, held = rows[r].scores(q)
                        hit = np.flatnonzero(held & (score >= least[q]))
                        if len(hit):
                            hit = firsts(-score, k, hit)
                            mine.add(-score[hit], rows[r].numbers()[hit], [rows[r].chunk_ids().take(pa.array(hit))])
        found = {key: b for key, b in best.items() if len(b.keys)}
        if found:
            ids = pa.array([key for key, b in found.items() for _ in b.keys], kind)
            arrays = [ids, pa.concat_arrays([b.rest[0] for b in found.values()]), pa.array(np.concatenate([b.numbers for b in found.values()])), pa.array(-np.concatenate([b.keys for b in found.values()]))]
            yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "chunk_id", "number", "score"])
        give_back()

    return run


def _by_questions(blocks: Iterator[Block]) -> list[tuple[Asked, list[Block]]]:
    groups: dict[int, tuple[Asked, list[Block]]] = {}
    for b in blocks:
        groups.setdefault(id(b.asked), (b.asked, []))[1].append(b)
    return list(groups.values())


def _few(batch: pa.RecordBatch, cache: dict[int, Asked]) -> Iterator[tuple[Asked, list[Block]]]:
    """The blocks of a batch by their questions, OPEN of its rows at once."""
    for at in range(0, batch.num_rows, OPEN):
        yield from _by_questions(opened(batch.slice(at, OPEN), cache))


def _promising(most: int, kind: str):
    """(query_id, base, bound): the blocks of a task with the greatest bounds for each question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, Asked] = {}
        for batch in batches:
            for asked, rows in _by_questions(opened(batch, cache)):
                bounds = np.array([b.bounds() for b in rows])
                bases = np.array([b.batch.column("base")[b.i].as_py() for b in rows])
                at = np.argsort(-bounds, axis=0, kind="stable")[:most].T
                q = np.repeat(np.arange(len(asked.keys)), at.shape[1])
                yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(q)).cast(kind), pa.array(bases[at.ravel()]), pa.array(bounds[at.ravel(), q])], names=["query_id", "base", "bound"])

    return run


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def top_scored(blocks: Blocks, questions: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, number, score, rank from 0): the k best of each question among the chunks that hold one of its terms, by the
    score rounded to nine places, ties to the smaller chunk_id.

    Where there are many blocks, each question first visits those with its greatest bounds; its k-th score there is its first threshold.
    A task then returns at most k rows a question, and none below the threshold.
    """
    kind, q_type = arrow_type(questions, "query_id"), questions.schema["query_id"].dataType.simpleString()
    shape = f"query_id {q_type}, chunk_id {blocks.chunk_type}, number long, score double"
    frame = blocks.frame.drop("vectors")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "number")
    asked = staged(questions)
    if blocks.blocks > SAMPLE:
        heads = meet(frame.select("base", "terms", "tops"), asked).mapInArrow(_promising(FIRST, kind), f"query_id {q_type}, base long, bound double")
        by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "base")
        visits = heads.withColumn("_n", F.row_number().over(by_bound)).filter(F.col("_n") <= FIRST).select("query_id", "base")
        # each visited block with the questions that visit it
        packed = visits.join(asked, "query_id").groupBy("base").agg(F.collect_list(F.struct(*asked.columns)).alias("asked"))
        first = frame.join(packed.withColumn("q_block", F.col("base")), "base").mapInArrow(_scored(k, kind), shape)
        least = first.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).filter(F.col("_n") == k).select("query_id", F.col("score").alias("least"))
        asked = staged(asked.join(least, "query_id", "left"))
    found = meet(frame, asked).mapInArrow(_scored(k, kind), shape)
    ranked = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
    return ranked.select("query_id", "chunk_id", "number", "score", (F.col("_n") - 1).cast("long").alias("rank"))
