"""Exact top-k inner products by norm buckets.

Vectors are grouped by length into blocks.  A query's k-th best score so far, divided by the product of the lengths, is the least
cosine that a better partner in a block must have (the local threshold).  Where no partner can reach it, the block is skipped; where
the threshold is high, coordinates prune: a partner's coordinate must lie near the query's, which bounds the rest by the lengths of what
remains; else only lengths prune.  Products of what is left are verified in exact integers, of any size.

A task holds some of the queries and meets some of the blocks one after another, so it needs memory for its queries and a batch only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.llm.common import stash

#: Vectors in a block of candidates and in a block of queries.
BLOCK, QUERIES = 2048, 256
#: Width of a length bucket, as the logarithm of the ratio of the lengths.
WIDTH = 0.02
#: Local thresholds (cosines) above which coordinates prune before products are formed.
COORDINATES_FROM = 0.9
#: Components from here on can't be multiplied in doubles.
LARGEST = 2.0**500
#: Bytes of query vectors that a task holds.
HELD = 32 << 20


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id long, v array<double>, dim int, norm double) with components floor(scale * x), whole numbers.

    Vectors that are null or empty, or hold null or non-finite components, take no part.  A component beyond LARGEST, of which squares
    would leave a double, raises an error; floats never reach it.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(F.coalesce(fine, F.lit(False)))

    def whole(x):
        y = x.cast("double") * scale
        # from 2**52 on every double is whole, and floor() would cut it to a long
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).when(F.abs(y) < LARGEST, y).otherwise(F.raise_error("a vector's component is too large for products").cast("double"))

    rows = rows.select(F.col(key).cast("long").alias("id"), F.transform(vector, whole).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("id", "v", F.size("v").alias("dim"), norm.alias("norm"))


_BLOCKS = "dim int, block long, top double, rows binary, ids binary, vectors binary"


def _vector_bytes(vectors: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 2, 4 and 8 bytes that holds all of them; 8 are doubles."""
    most = np.abs(vectors).max(initial=0)
    return vectors.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8").tobytes()


def _vectors(raw: pa.Buffer, n: int, dim: int) -> np.ndarray:
    """n vectors of doubles from _vector_bytes."""
    return np.frombuffer(raw, {2: "<i2", 4: "<i4", 8: "<f8"}[raw.size // (n * dim)]).reshape(n, dim).astype("<f8")


def _packed(dim: int, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([dim], pa.int32()), pa.array([int(rows[0])], pa.int64()), pa.array([float(norms.max())]), *(pa.array([x], pa.binary()) for x in (rows.tobytes(), ids.tobytes(), _vector_bytes(vectors)))],
        names=["dim", "block", "top", "rows", "ids", "vectors"],
    )


def _pack(size: int):
    """Rows sorted by dimension and length to blocks: their numbers, ids and vectors as bytes, and the greatest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            dims, rows, ids, norms = (batch.column(c).to_numpy() for c in ("dim", "row", "id", "norm"))
            flat = batch.column("v").flatten().to_numpy()
            starts = np.concatenate(([0], np.cumsum(dims)))
            # consecutive rows of one dimension
            for part in np.split(np.arange(len(dims)), np.flatnonzero(np.diff(dims)) + 1):
                for lo in range(0, len(part), size):
                    at = part[lo : lo + size]
                    d = int(dims[at[0]]) if len(at) else 0
                    if d:
                        held.setdefault(d, []).append((rows[at], ids[at], flat[starts[at[0]] : starts[at[-1] + 1]].reshape(len(at), d), norms[at]))
                        if sum(len(x[0]) for x in held[d]) >= size:
                            yield _packed(d, *(np.concatenate(x) for x in zip(*held.pop(d), strict=True)))
        for d, kept in held.items():
            yield _packed(d, *(np.concatenate(x) for x in zip(*kept, strict=True)))

    return run


def _exact(q: np.ndarray, c: np.ndarray) -> list[int]:
    """The inner products of one vector with others, in integers of any size."""
    whole = [int(x) for x in q]
    return [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in c]


def _chosen(near: np.ndarray, q: np.ndarray, c: np.ndarray, k: int, least: float) -> tuple[np.ndarray, list[int]]:
    """(places in c, exact products) of the vectors of c that may be among a vector's k best of at least `least`; near: c @ q in doubles.

    Where doubles may round, they only choose: within their error bound of the k-th best, products are formed again in integers.
    """
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * len(q) < 2**53:
        hit = np.flatnonzero(near >= least)
        if len(hit) > k:
            hit = hit[near[hit] >= np.partition(near[hit], len(hit) - k)[len(hit) - k]]
        return hit, near[hit].astype(np.int64).tolist()
    error = (len(q) + 4) * 2.0**-52 * (np.abs(c) @ np.abs(q))
    hit = np.flatnonzero(near + error >= least)
    if len(hit) > k:
        sure = near[hit] - error[hit]
        hit = hit[near[hit] + error[hit] >= np.partition(sure, len(hit) - k)[len(hit) - k]]
    return hit, _exact(q, c[hit])


def search_block(q_rows, q_ids, q, least, c_rows, c_ids, c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row and id of the query, id of the candidate, score) of each query's k best in a block, itself left out; ties to smaller ids.

    Candidates that can't reach least, the query's k-th best score so far, may be missing.  Scores are longs, or Python's integers where
    longs may not hold them.
    """
    q_norm, c_norm = (np.sqrt((x**2).sum(1)) for x in (q, c))
    slack = 1 + 1e-9
    top = c_norm.max(initial=0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where((q_norm * top) > 0, least / (q_norm * top), np.where(least > 0, np.inf, -np.inf))
    alive = np.flatnonzero(local <= slack)
    # no sum of products of some coordinates is greater than the lengths' product: up to here all of them are whole numbers
    largest = q_norm[alive].max(initial=0.0) * top * slack
    whole = largest < 2**53
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def tell(i: int, some: np.ndarray, near: np.ndarray, vectors: np.ndarray) -> None:
        other = np.flatnonzero(c_rows[some] != q_rows[i])
        if len(other) < len(some):
            some, near, vectors = some[other], near[other], vectors[other]
        at, scores = _chosen(near, q[i], vectors, k, least[i])
        first = sorted(zip(scores, c_ids[some[at]].tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:k]
        found.append((np.full(len(first), i), np.array([x[1] for x in first], np.int64), np.array([x[0] for x in first], np.int64 if whole else object)))

    by_length = alive[local[alive] < COORDINATES_FROM]
    if len(by_length):
        # a candidate that is too short for the weakest threshold can't be in any answer
        some = np.flatnonzero(c_norm * q_norm[by_length].max() * slack + 1e-6 >= least[by_length].min())
        if whole:
            some = some[np.argsort(c_ids[some], kind="stable")]
            kind = np.float32 if largest < 2**24 else np.float64
            at, which, scores = _first_columns(q[by_length].astype(kind) @ c[some].astype(kind).T, q_rows[by_length], c_rows[some], least[by_length], k)
            found.append((by_length[at], c_ids[some[which]], scores))
        else:
            near = q[by_length] @ c[some].T
            for i, row in zip(by_length, near, strict=True):
                tell(i, some, row, c[some] if len(some) < len(c) else c)
    for i in alive[local[alive] >= COORDINATES_FROM]:
        # on the query's largest coordinate f: q_f c_f + |rest of q| |rest of c| bounds the product; rounding may leave 1e-7 of the lengths
        f = np.abs(q[i]).argmax()
        rest = np.sqrt(np.maximum(q_norm[i] ** 2 - q[i, f] ** 2, 0)) * np.sqrt(np.maximum(c_norm**2 - c[:, f] ** 2, 0))
        some = np.flatnonzero(q[i, f] * c[:, f] + rest + 1e-7 * q_norm[i] * c_norm + 1e-6 >= least[i])
        if len(some):
            tell(i, some, c[some] @ q[i], c[some])
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at, vec, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return q_rows[at], q_ids[at], vec, score


def _first_columns(near: np.ndarray, q_rows: np.ndarray, c_rows: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, column, score) of the k greatest of each line that reach its least, the line's own row left out; ties to the first columns.

    near: exact products, whose columns stand in the order of the ids.
    """
    order = np.argsort(c_rows, kind="stable")
    at = np.minimum(np.searchsorted(c_rows, q_rows, sorter=order), max(0, len(order) - 1))
    own = np.flatnonzero(c_rows[order[at]] == q_rows) if len(order) else np.zeros(0, np.int64)
    near[own, order[at[own]]] = -np.inf
    # never equal to -inf, so that the own row is out
    floor = np.maximum(least, float(np.finfo(np.float32).min)).astype(near.dtype)
    lines, columns = np.divmod(np.flatnonzero(near >= floor[:, None]), max(1, near.shape[1]))
    many = np.bincount(lines, minlength=len(near)) > k
    few = ~many[lines]
    parts = [(lines[few], columns[few])]
    for i in np.flatnonzero(many):
        hit = np.flatnonzero(near[i] >= max(floor[i], np.partition(near[i], near.shape[1] - k)[near.shape[1] - k]))
        hit = hit[np.argsort(-near[i, hit], kind="stable")[:k]]
        parts.append((np.full(len(hit), i), hit))
    lines, columns = (np.concatenate(x) for x in zip(*parts, strict=True))
    return lines, columns, near[lines, columns].astype(np.int64)


def _sortable(score: int) -> bytes:
    """Bytes in the order of integers that leave 64 bits; empty for others, whose long tells them apart."""
    if -(1 << 63) < score < (1 << 63) - 1:
        return b""
    size = (score.bit_length() >> 3) + 1
    sign, order = (1, size) if score > 0 else (0, 0xFFFF - size)
    return bytes([sign]) + order.to_bytes(2, "big") + score.to_bytes(size, "big", signed=True)


class _Asked:
    """A block of queries in a task, with the best hits so far; rows: sorted."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray):
        self.rows, self.ids, self.vectors, self.least = rows, ids, vectors, least
        self.top = float(np.sqrt((vectors**2).sum(1)).max())
        self.hits: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(4))

    def meet(self, top: float, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        hits = search_block(self.rows, self.ids, self.vectors, self.least, rows, ids, vectors, k)
        if not len(hits[0]):
            return
        at, asked, vec, score = (np.concatenate(x) for x in zip(self.hits, hits, strict=True))
        if score.dtype == object:
            order = np.array(sorted(range(len(at)), key=lambda i: (at[i], -score[i], vec[i])), np.int64)
        else:
            order = np.lexsort((vec, -score, at))
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
        last = order[rank == k - 1]
        order = order[rank < k]
        self.hits = at[order], asked[order], vec[order], score[order]
        # as a double that isn't above the k-th best
        bound = np.nextafter(score[last].astype(np.float64), -np.inf)
        place = np.searchsorted(self.rows, at[last])
        self.least[place] = np.maximum(self.least[place], bound)

    def told(self) -> pa.RecordBatch:
        at, asked, vec, score = self.hits
        if score.dtype == object:
            shown = pa.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in score], pa.int64())
            beyond = pa.array([_sortable(x) for x in score], pa.binary())
        else:
            shown, beyond = pa.array(score), pa.array([b""] * len(score), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(asked), pa.array(vec), shown, beyond], names=["q_row", "query_id", "vec_id", "score", "beyond"])


def _search(k: int):
    """Cells one after another, each its blocks of queries (those with least) and then its blocks of candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked = None, {}
        for batch in batches:
            cells, dims, tops = (batch.column(x).to_numpy() for x in ("cell", "dim", "top"))
            for at in range(batch.num_rows):
                if cells[at] != cell:
                    yield from (x.told() for some in asked.values() for x in some)
                    cell, asked = cells[at], {}
                least, rows, ids, vectors = (batch.column(x)[at].as_buffer() for x in ("least", "rows", "ids", "vectors"))
                dim = int(dims[at])
                if least is None and dim not in asked:
                    continue
                rows, ids = (np.frombuffer(x, "<i8") for x in (rows, ids))
                vectors = _vectors(vectors, len(rows), dim)
                if least is not None:
                    asked.setdefault(dim, []).append(_Asked(rows.copy(), ids.copy(), vectors, np.frombuffer(least, "<f8").copy()))
                    continue
                for some in asked[dim]:
                    if some.least.min() <= some.top * tops[at] * (1 + 1e-9):
                        some.meet(tops[at], rows, ids, vectors, k)
        yield from (x.told() for some in asked.values() for x in some)

    return run


_HITS = "q_row long, query_id long, vec_id long, score long, beyond binary"


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_row").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k highest integer inner products of each query among all other vectors, ties to the smaller id.

    vectors: as integer_vectors makes them; is_query: which rows ask.  Returns (query_id long, rank
    int from 1, vec_id long, score long); fewer rows where fewer candidates have the query's dimension.  Empty tables give none.  Rows
    that share an id are vectors of their own: each asks for itself, so their ranks repeat, and each is a candidate of the others.
    Products are exact and ranked exactly, whatever their size; a score beyond 64 bits is returned as the nearest long.

    Candidates are packed into blocks of 2,048 of like length, queries into blocks of 256.  First each query meets two blocks of the
    greatest lengths, which gives its first threshold; then all other blocks, of which those whose lengths can't reach the weakest
    threshold of the query block are left out.  Where all vectors have one length (normalised embeddings), only coordinates prune.
    Blocks meet in a grid of cells, a task each: a line of it has some of the queries, at most HELD bytes, a column some of the
    candidates.  Both come to a cell by one shuffle; nothing but the numbers and lengths of the blocks is broadcast.
    """
    spark = vectors.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = stash(vectors.withColumn("row", F.monotonically_increasing_id()))
    bucket = F.floor(F.log(F.greatest("norm", F.lit(1e-9))) / WIDTH)
    # sorted runs of one dimension and one length bucket; a bucket that many vectors share is spread by its id
    dealt = numbered.withColumn("_bucket", bucket).repartitionByRange(parts, "dim", F.col("_bucket").desc(), F.xxhash64("row")).sortWithinPartitions("dim", F.col("_bucket").desc())
    blocks = stash(dealt.select("row", "id", "v", "dim", "norm").mapInArrow(_pack(BLOCK), _BLOCKS))
    queries = numbered.filter(is_query)
    asking, weight = queries.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0)) * 8).first()
    spread = max(1, -(-asking // QUERIES))
    asked = queries.withColumn("_q", F.pmod(F.xxhash64("row"), F.lit(spread)))
    # a few numbers for each block
    by_top = Window.partitionBy("dim").orderBy(F.col("top").desc(), "block")
    ranked = blocks.select("dim", "block", "top", (F.length("ids") / 8).cast("long").alias("_size")).withColumn("_n", F.row_number().over(by_top)).withColumn("_first", F.col("_n") <= 2)
    sizes = {r["_first"]: r for r in ranked.groupBy("_first").agg(F.count("*").alias("blocks"), F.sum("_size").alias("vectors")).collect()}

    def hits(asked: DataFrame, first: bool) -> DataFrame:
        held, n = (sizes[first]["vectors"], sizes[first]["blocks"]) if first in sizes else (1, 1)
        # as few bytes are sent as a cell a partition allows; columns of less than a block aren't worth a task
        most = min(n, -(-held // BLOCK))
        lines = max(1, min(spread, max(round((parts * asking / held) ** 0.5), -(-weight // HELD), -(-parts // most))))
        columns = min(most, -(-parts // lines))
        packed = asked.groupBy("dim", "_q").agg(F.collect_list(F.struct("row", "id", "v", "least")).alias("_rows"))
        packed = packed.mapInArrow(_pack_queries, "dim int, q_block long, rows binary, ids binary, vectors binary, least binary")
        column = F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
        packed = packed.withColumn("_column", column).withColumn("cell", F.col("q_block") % lines * columns + F.col("_column")).withColumn("top", F.lit(float("inf")))
        # columns get blocks of all lengths, those of another dimension from another column on
        some = blocks.drop("top").join(F.broadcast(ranked.filter(F.col("_first") == first)), ["dim", "block"])
        some = some.withColumn("_column", F.pmod(F.col("_n") + F.pmod(F.xxhash64("dim"), F.lit(columns)), F.lit(columns)))
        some = some.withColumn("_line", F.explode(F.sequence(F.lit(0), F.lit(lines - 1)))).withColumn("cell", F.col("_line") * columns + F.col("_column")).withColumn("least", F.lit(None).cast("binary"))
        names = ["cell", "dim", "top", "rows", "ids", "vectors", "least"]
        both = packed.select(names).unionByName(some.select(names)).repartitionById(lines * columns, F.col("cell").cast("int"))
        # queries first, then long vectors before shorter ones
        return both.sortWithinPartitions("cell", F.col("least").isNull(), F.col("top").desc()).mapInArrow(_search(k), _HITS)

    found = stash(_best(hits(asked.withColumn("least", F.lit(float("-inf"))), True), k))
    # the k-th best score so far as a double that isn't above it; a score that was cut from below is no bound
    score = F.col("score").cast("double")
    bound = F.when(F.col("score") > -(2**63), score - F.abs(score) * 1e-15)
    least = found.filter(F.col("rank") == k).select(F.col("q_row").alias("row"), bound.alias("least"))
    rest = hits(asked.join(least, "row", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), False)
    both = found.select("q_row", "query_id", "vec_id", "score", "beyond").unionByName(rest)
    return _best(both, k).select("query_id", "rank", "vec_id", "score")


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            asked = batch.column("_rows")[at].values
            dim = batch.column("dim")[at].as_py()
            rows, ids, least = (asked.field(x).to_numpy() for x in ("row", "id", "least"))
            vectors = asked.field("v").flatten().to_numpy().reshape(-1, dim)
            order = np.argsort(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), batch.column("_q").slice(at, 1), *(pa.array([x], pa.binary()) for x in (rows[order].tobytes(), ids[order].tobytes(), _vector_bytes(vectors[order]), least[order].tobytes()))],
                names=["dim", "q_block", "rows", "ids", "vectors", "least"],
            )


def norm_bucket_topk(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """top_products over a table's integer vectors; queries are the rows whose id is divisible by `every`."""
    return top_products(integer_vectors(df, key, vector), F.col("id") % every == 0, k)
