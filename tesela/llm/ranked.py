"""Ranked lexical search over a length-stratified index.

Documents of one normaliser m form a stratum, which is cut into shards.  A shard holds its postings by term and tf, so the impact of a
term frequency is computed once for all documents that share it, and the greatest tf of a term bounds what the term can add there.  The
sum of an item's bounds is the shard's bound: shards are visited from the greatest down, and once the k best beat a shard's bound, it and
all behind it are left out.

Items are a stated set of queries, taken in blocks of bounded text; the index of a block holds the terms that its items ask for.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesela.llm.common import clear, release, stash, text_bytes

#: Bytes of folded text that are split into terms at once.
SLICE = 1 << 22
#: Documents in a shard, shards that each item visits first, bytes of text in a block of items.
SHARD, FIRST, ITEM_BYTES = 4096, 2, 16 << 20

#: What belongs to a term, in lower case; spaces elsewhere.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def folded_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in lists of about SLICE bytes: runs of ASCII letters and digits and of all beyond ASCII, only A
    to Z lower-cased."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE) if len(folded) - at > SLICE else -1
        end = end if end >= 0 else len(folded)
        yield folded[at:end].split()
        at = end


def _count(asked: dict[bytes, int]):
    """(doc, n, terms, tfs): a document's number of terms, and the numbers and frequencies of those that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            sizes, numbers, tfs, ends = [], [], [], [0]
            for lo, hi in zip(offsets, offsets[1:], strict=False):
                n, counts = 0, Counter()
                for some in folded_terms(data[lo:hi].tobytes()):
                    n += len(some)
                    counts.update(map(asked.get, some))
                del counts[None]
                own = sorted(counts.items())
                sizes.append(n)
                numbers += [t for t, _ in own]
                tfs += [f for _, f in own]
                ends.append(len(numbers))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (numbers, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), *lists], names=["doc", "n", "terms", "tfs"])
        release()

    return run


def impact(tf, m):
    """(10**9 tf) div (1000 tf + 20 m)."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


_SHARD = "m long, docs array<long>, terms binary, tops binary, group_term binary, group_tf binary, group_size binary, places binary"


def _shard(m: int, docs: pa.Array, terms: np.ndarray, tfs: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
    """One row: a shard's documents and its postings by term and tf."""
    order = np.lexsort((owners, tfs, terms))
    terms, tfs, owners = terms[order], tfs[order], owners[order]
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(terms) != 0) | (np.diff(tfs) != 0))))
    group_term, group_tf = terms[starts], tfs[starts]
    last = np.flatnonzero(np.concatenate((np.diff(group_term) != 0, [True])))
    parts = [group_term[last], group_tf[last], group_term, group_tf, np.diff(np.concatenate((starts, [len(terms)])))]
    columns = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in parts]
    held = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
    return pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), held, *columns, pa.array([owners.astype("<u2").tobytes()], pa.binary())], names=["m", "docs", "terms", "tops", "group_term", "group_tf", "group_size", "places"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by m to shards of at most SHARD documents of one m."""
    held: list[pa.RecordBatch] = []

    def packed() -> Iterator[pa.RecordBatch]:
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            terms, tfs, docs = (rows.column(c).combine_chunks() for c in ("terms", "tfs", "doc"))
            sizes = terms.value_lengths().to_numpy()
            yield _shard(rows.column("m")[0].as_py(), docs, terms.flatten().to_numpy(), tfs.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes))
            held.clear()

    for batch in batches:
        ms = batch.column("m").to_numpy()
        for run in np.split(np.arange(len(ms)), np.flatnonzero(np.diff(ms)) + 1) if len(ms) else []:
            at, end = int(run[0]), int(run[-1]) + 1
            if held and held[0].column("m")[0].as_py() != ms[at]:
                yield from packed()
            while at < end:
                some = min(end - at, SHARD - sum(x.num_rows for x in held))
                held.append(batch.slice(at, some))
                at += some
                if sum(x.num_rows for x in held) == SHARD:
                    yield from packed()
    yield from packed()


@dataclass
class Items:
    """A block of items: their distinct terms with weights one after another, and where each item's begin."""

    terms: np.ndarray
    weights: np.ndarray
    starts: np.ndarray

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.terms[self.starts[i] : self.starts[i + 1]], self.weights[self.starts[i] : self.starts[i + 1]]

    def bounds(self, m: int, terms: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """What each item's score can be at most among documents of normaliser m whose greatest frequencies are tops."""
        if not len(terms):
            return np.zeros(len(self.starts) - 1, np.int64)
        most = impact(tops.astype(np.int64), m)
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        gains = np.concatenate(([0], np.cumsum(np.where(terms[at] == self.terms, self.weights * most[at], 0))))
        return gains[self.starts[1:]] - gains[self.starts[:-1]]


class Shard:
    """A shard's row, opened: impacts are computed once for each of its frequencies."""

    def __init__(self, row: dict):
        self.m, self.docs = row["m"], row["docs"]
        self.terms, group_term, group_tf, group_size = (np.frombuffer(row[c], "<i4") for c in ("terms", "group_term", "group_tf", "group_size"))
        self.places = np.frombuffer(row["places"], "<u2")
        tf, which = np.unique(group_tf, return_inverse=True)
        self.impacts = np.repeat(impact(tf.astype(np.int64), self.m)[which], group_size)
        ends = np.concatenate(([0], np.cumsum(group_size)))
        self.starts = np.append(ends[np.searchsorted(group_term, self.terms)], ends[-1])

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.docs), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        for i in np.flatnonzero(self.terms[at] == terms):
            lo, hi = self.starts[at[i]], self.starts[at[i] + 1]
            out[self.places[lo:hi]] += weights[i] * self.impacts[lo:hi]  # a term meets a document once
        return out


class Best:
    """An item's k best (score, document) so far; documents without an id come last among equals."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(1, least)
        self.scores, self.docs = np.zeros(0, np.int64), pa.array([], pa.int64())

    def add(self, scores: np.ndarray, docs: pa.Array) -> None:
        hit = np.flatnonzero(scores >= self.least)
        if not len(hit):
            return
        scores = np.concatenate((self.scores, scores[hit]))
        docs = pa.concat_arrays([self.docs, docs.take(pa.array(hit))])
        unknown = docs.is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((docs.fill_null(0).to_numpy(), unknown, -scores))[: self.k]
        self.scores, self.docs = scores[order], docs.take(pa.array(order))
        if len(order) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def _visit(items: Items, k: int, least: np.ndarray):
    """(item, doc, score) of each item's k best of a task's shards that reach least, with only the shards visited whose bounds do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            bounds = np.zeros((batch.num_rows, len(least)), np.int64)
            for s in range(batch.num_rows):
                row = {c: batch.column(c)[s].as_py() for c in ("m", "terms", "tops")}
                bounds[s] = items.bounds(row["m"], *(np.frombuffer(row[c], "<i4") for c in ("terms", "tops")))
            wanted = batch.column("item").to_pylist() if "item" in batch.schema.names else None
            opened: dict[int, Shard] = {}
            for i in range(len(least)):
                if not (bounds[:, i] >= max(1, least[i])).any():
                    continue
                mine = best.setdefault(i, Best(k, int(least[i])))
                terms, weights = items.of(i)
                for s in np.argsort(-bounds[:, i], kind="stable"):
                    if bounds[s, i] < mine.least:
                        break
                    if wanted is not None and i not in wanted[s]:
                        continue
                    if s not in opened:
                        opened[s] = Shard({c: batch.column(c)[s].values if c == "docs" else batch.column(c)[s].as_py() for c in ("m", "docs", "terms", "group_term", "group_tf", "group_size", "places")})
                    mine.add(opened[s].scores(terms, weights), opened[s].docs)
        found = [(i, b) for i, b in best.items() if len(b.scores)]
        if found:
            numbers = np.repeat([i for i, _ in found], [len(b.scores) for _, b in found])
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.concat_arrays([b.docs for _, b in found]), pa.array(np.concatenate([b.scores for _, b in found]))], names=["item", "doc", "score"])

    return run


def _promising(items: Items, most: int):
    """(item, shard, bound): the shards of a batch with the greatest bounds for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("shard").to_numpy()
            bounds = np.zeros((len(items.starts) - 1, len(ids)), np.int64)
            for s, row in enumerate(batch.select(["m", "terms", "tops"]).to_pylist()):
                bounds[:, s] = items.bounds(row["m"], *(np.frombuffer(row[c], "<i4") for c in ("terms", "tops")))
            at = np.argsort(-bounds, axis=1, kind="stable")[:, :most]
            number = np.repeat(np.arange(len(bounds)), at.shape[1])
            top = bounds[number, at.ravel()]
            fine = top > 0
            yield pa.RecordBatch.from_arrays([pa.array(number[fine], pa.int32()), pa.array(ids[at.ravel()][fine]), pa.array(top[fine])], names=["item", "shard", "bound"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_block(docs: DataFrame, asked: list[list[bytes]], k: int, made: list[str]) -> DataFrame:
    """(item int, doc long, score long, rank int) of the k best documents of each item; asked: each item's distinct terms.

    docs: (doc, text).  Texts are read once, into a row of counts a document; strata are dealt by range, one that many documents share by
    their hashes, so no task depends on a stratum's size.  Each item's two most promising shards of all give its first threshold.
    """
    spark, parts = docs.sparkSession, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = {t: i for i, t in enumerate(sorted({t for terms in asked for t in terms}))}
    counted = stash(docs.mapInArrow(_count(number), "doc long, n long, terms array<int>, tfs array<int>").filter("n > 0"), made)
    total = counted.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("n").cast("decimal(38,0)")).alias("terms")).first()
    none = spark.createDataFrame([], "item int, doc long, score long, rank int")
    if not total["documents"]:
        return none
    many, length = total["documents"], int(total["terms"])
    # at most a row for each term of the block
    df = {r["term"]: r["df"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    weigh = {t: math.floor(1000 * math.log((2 * many + 2) / (2 * df[i] + 1))) for t, i in number.items() if i in df}
    own = [sorted(number[t] for t in terms if weigh.get(t)) for terms in asked]
    weight = {number[t]: w for t, w in weigh.items()}
    flat = [t for terms in own for t in terms]
    items = Items(np.array(flat, np.int64), np.array([weight[t] for t in flat], np.int64), np.concatenate(([0], np.cumsum([len(t) for t in own], dtype=np.int64))))
    if not flat:
        return none
    m = F.expr(f"50 + (cast(50 as decimal(2,0)) * cast(n as decimal(12,0)) * cast({many} as decimal(20,0))) div cast({length} as decimal(30,0))")
    placed = counted.filter(F.size("terms") > 0).select("doc", "terms", "tfs", m.cast("long").alias("m"))
    placed = placed.repartitionByRange(parts, "m", F.xxhash64("doc", "terms", "tfs")).sortWithinPartitions("m")
    shards = stash(placed.mapInArrow(_pack, _SHARD).withColumn("shard", F.monotonically_increasing_id()), made)
    heads = shards.select("shard", "m", "terms", "tops").mapInArrow(_promising(items, FIRST), "item int, shard long, bound long")
    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "shard")
    first = heads.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= FIRST).groupBy("shard").agg(F.collect_set("item").alias("item"))
    columns = [c.split()[0] for c in _SHARD.split(", ")]
    found = _ranked(shards.join(first, "shard").select(*columns, "item").mapInArrow(_visit(items, k, np.zeros(len(own), np.int64)), "item int, doc long, score long"), k)
    least = np.zeros(len(own), np.int64)
    for r in found.filter(F.col("rank") == k).select("item", "score").collect():  # at most a row for each item of the block
        least[r["item"]] = r["score"]
    return _ranked(shards.select(*columns).mapInArrow(_visit(items, k, least), "item int, doc long, score long"), k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank int from 1, doc, score long) of each item's k highest-scoring documents with a score above 0; fewer where fewer score.

    Null texts hold no term; documents without a term count for nothing, items without one give no rows.  A term that nearly every
    document holds may weigh 0.  Equal scores go to the smaller document id, an unknown (null) one last.  Rows that share a document id
    are documents of their own, rows that share an item id items of their own, so its ranks repeat.  Texts may be of any length: they are
    split in slices.  Other columns are not looked at.

    Items come in blocks of about ITEM_BYTES of text, by a hash of their rows, so what workers receive is bounded; a block reads all
    documents once.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    key = items.schema[item].dataType.simpleString()
    asked = items.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    made: list[str] = []
    out = spark.createDataFrame([], f"`{item}` {key}, rank int, `{doc}` long, score long")
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        terms = [sorted({t for some in folded_terms((r["text"] or "").encode()) for t in some}) for r in rows]
        if not any(terms):
            continue
        found = stash(rank_block(named, terms, k, made))
        clear(spark, made)
        ids = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"_i int, _id {key}")
        named_items = found.join(F.broadcast(ids), F.col("item") == F.col("_i"))  # as many rows as the block has items
        out = out.unionByName(named_items.select(F.col("_id").alias(item), "rank", F.col("doc").alias(doc), "score"))
    return out
