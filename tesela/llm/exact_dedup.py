"""Exact deduplication in the manner of a Grace hash join: texts are dealt to buckets, and an open-addressing table in each task
compares complete content; parts of a bucket that don't fit are spilled to the shared folder and dealt again, until every bucket fits.

Copies meet early: each task first collapses the copies among the rows that it reads, so however large a group of copies is, one
text of it at most per task is shuffled.  Buckets return one small row per distinct text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import release, stash, text_bytes, whole_row

#: Bytes of text that a task's tables may hold; a bucket should get a quarter of it.
TABLE_BYTES = 96 << 20
#: Buckets that one deal makes at most; more rows than they can hold are dealt in several levels.
MOST_BUCKETS = 20_000
#: Hash bits that tell the parts of an overfull bucket apart.
PART_BITS = 4


def fold(text: bytes) -> bytes:
    """Lower-case A to Z and nothing else."""
    return text.lower()


class ContentTable:
    """An open-addressing table of texts with linear probing: a slot matches only if its complete content is equal."""

    def __init__(self):
        self.size = 0
        self._slots = np.full(1 << 10, -1, np.int64)
        self.texts: list[bytes | None] = []
        self.digests: list[bytes] = []
        self.keep: list[int | None] = []
        self.count: list[int] = []

    def add(self, digest: bytes, text: bytes, keep: int | None, count: int) -> None:
        if 2 * (len(self.texts) + 1) > len(self._slots):
            self._grow()
        at = self._find(digest, text)
        k = int(self._slots[at])
        if k < 0:
            self._slots[at] = len(self.texts)
            self.texts.append(text)
            self.digests.append(digest)
            self.keep.append(keep)
            self.count.append(count)
            self.size += len(text) + 200
        else:
            self.keep[k] = keep if self.keep[k] is None else self.keep[k] if keep is None else max(self.keep[k], keep)
            self.count[k] += count

    def _find(self, digest: bytes, text: bytes) -> int:
        mask = len(self._slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (k := self._slots[at]) >= 0:
            if self.texts[k] == text:
                return at
            if self.digests[k] == digest:
                raise ValueError("two different texts have one SHA-256 digest; rows can't be told apart by it")
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self._slots = np.full(2 * len(self._slots), -1, np.int64)
        mask = len(self._slots) - 1
        for k, digest in enumerate(self.digests):
            at = int.from_bytes(digest[-8:], "little") & mask
            while self._slots[at] >= 0:
                at = (at + 1) & mask
            self._slots[at] = k


_GROUPS = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("n_bytes", pa.int64()), ("text", pa.binary())])
_SCHEMA = "digest binary, keep_id long, group_size long, n_bytes long, text binary"


def _rows(table: ContentTable, with_text: bool) -> Iterator[pa.RecordBatch]:
    """The table's entries in batches of about 8 MB."""
    ks, start = range(len(table.texts)), 0
    while start < len(ks):
        end, size = start, 0
        while end < len(ks) and (size < 8 << 20) and end - start < 20_000:
            size += len(table.texts[ks[end]]) if with_text else 0
            end += 1
        part = ks[start:end]
        yield pa.RecordBatch.from_arrays([
            pa.array([table.digests[k] for k in part], pa.binary()), pa.array([table.keep[k] for k in part], pa.int64()), pa.array([table.count[k] for k in part], pa.int64()),
            pa.array([len(table.texts[k]) for k in part], pa.int64()), pa.array([table.texts[k] if with_text else None for k in part], pa.binary()),
        ], schema=_GROUPS)
        start = end


def _collapse(budget: int):
    """Collapse the copies among a task's rows (doc_id, text); a full table is emptied and goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            data = memoryview(data)
            for i, key in enumerate(batch.column("doc_id").to_pylist()):
                text = fold(bytes(data[offsets[i] : offsets[i + 1]]))
                table.add(hashlib.sha256(text).digest(), text, key, 1)
                if table.size > budget:
                    yield from _rows(table, True)
                    table = ContentTable()
        yield from _rows(table, True)
        del table
        release()

    return run


def _bucket(budget: int, level: int):
    """Build the tables of a task's bucket, one a part; parts that don't fit leave with their texts, to be dealt again.

    The largest part leaves first, and any may leave, so what stays is within the budget; only a part of a single text, which no further
    deal could make smaller, stays whatever its size if it is the last.
    """
    odd = pow(0x9E3779B97F4A7C15, level + 1, 1 << 64)

    def part_of(digest: bytes) -> int:
        return (int.from_bytes(digest[8:16], "big") * odd % (1 << 64)) >> (64 - PART_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, ContentTable] = {k: ContentTable() for k in range(1 << PART_BITS)}
        size = 0
        for batch in batches:
            sent = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("digest", "text", "keep_id", "group_size")), strict=True):
                k = part_of(row[0])
                if k not in tables:
                    sent.append(row)
                    continue
                before = tables[k].size
                tables[k].add(*row)
                size += tables[k].size - before
                while size > budget:
                    k = max(tables, key=lambda i: tables[i].size)
                    if len(tables[k].texts) == 1 and sum(t.size > 0 for t in tables.values()) == 1:
                        break
                    size -= tables[k].size
                    yield from _rows(tables.pop(k), True)
            if sent:
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in sent], pa.binary()), pa.array([x[2] for x in sent], pa.int64()), pa.array([x[3] for x in sent], pa.int64()),
                    pa.array([len(x[1]) for x in sent], pa.int64()), pa.array([x[1] for x in sent], pa.binary()),
                ], schema=_GROUPS)
        for t in tables.values():
            yield from _rows(t, False)
        tables.clear()
        release()

    return run


def content_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """(digest binary, keep_id long, group_size long), one row per distinct folded text; see dedup_exact.

    A level deals its rows to buckets that should hold a quarter of a table each, by the bytes of its texts.  What its buckets spill is
    dealt again by another hash, all at once if most_buckets are enough for it, else in slices by hash, one after another.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # rows to deal, their bytes, and at which level
    waiting, done = [(named.mapInArrow(_collapse(table_bytes // 4), _SCHEMA), size, 0)], []
    while waiting:
        pending, size, level = waiting.pop()
        buckets = min(most_buckets, max(parts, -(-4 * size // table_bytes)))
        dealt = pending.repartition(buckets, F.xxhash64("digest", F.lit(level)))
        result = stash(dealt.mapInArrow(_bucket(table_bytes, level), _SCHEMA))
        done.append(result.filter(F.col("text").isNull()).select("digest", "keep_id", "group_size"))
        spilled = result.filter(F.col("text").isNotNull())
        size = spilled.agg(F.sum("n_bytes")).first()[0]
        if size is not None:
            slices = -(-4 * size // (table_bytes * most_buckets))
            slot = F.pmod(F.xxhash64("digest", F.lit(-1 - level)), F.lit(slices))
            waiting += [(spilled.filter(slot == k) if slices > 1 else spilled, size // slices, level + 1) for k in range(slices)]
    groups = done[0]
    for more in done[1:]:
        groups = groups.unionByName(more)
    return groups


def dedup_exact(docs: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 (lower-case hex of the folded text in UTF-8).

    Texts are equal when identical after lower-casing A to Z only; null counts as empty.  Of equal texts, the row with the largest key
    stays (a null key only if all are null; rows that share the largest key are all marked kept, and drop_copies() keeps one).  Two
    different texts with one SHA-256 digest would raise an error rather than merge.  Columns of docs with the names of the added ones
    are replaced.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    groups = content_groups(docs, key, text, table_bytes)
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(whole_row(docs, added), F.col(key).alias("_key"), F.unhex(F.sha2(folded, 256)).alias("digest"))
    kept = F.col("_key").eqNullSafe(F.col("keep_id"))
    return rows.join(groups, "digest").select("_row.*", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' columns: one per distinct folded text."""
    marked = dedup_exact(docs, key, text).filter("kept")
    # rows may share both key and text: one of them stays
    return marked.dropDuplicates(["text_sha256"]).select(*[F.col(f"`{c}`") for c in docs.columns])
