"""Removal of long repeated byte strings with run-length compressed Burrows-Wheeler indexes.

Every 200-byte string of a text belongs to one anchor: the leftmost place in it whose 32-byte hash is least.  Equal strings have equal
anchors at equal offsets, so all matches of a string lie among the pieces of text around one anchor hash.  A piece is what an anchor
owns: the union of its strings, at most 368 bytes.  The cluster counts anchors by hash; pieces of anchors that occur once can't repeat
and go no further.  Equal pieces (by 128 bits of hash) are one from there on: where there are several, all their strings repeat, and only
those of which the anchor has other pieces, too, enter the index, once.

Blocks of pieces (all pieces of an anchor hash in one block) are indexed: their Burrows-Wheeler transform is cut into runs, and only at
run ends are the text position and its neighbour in suffix order sampled.  Matching statistics are streamed from these samples: at a
sampled position the match with the neighbour is measured in the text, and from there it shrinks by one a byte until the next sample,
because inside a run neighbours stay neighbours.  The longer of the matches with either neighbour is the longest match of a position
with any other place in the block; where it reaches 200 bytes, the string repeats.

An anchor with too many different pieces for a block (a passage with many surroundings) is taken string by string instead: 128-bit
hashes of its 200-byte strings are counted with partial sums.  That is as exact: a string repeats if its hash occurs twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import RangeHash, mixed, row_ranges, stash, text_bytes, whole_row

#: Bytes of a string that must not repeat, bytes of an anchor.
LENGTH, ANCHOR = 200, 32
#: Bytes of text worked on at once; bytes of pieces in an indexed block; different pieces of one anchor that a block may hold.
CHUNK, BLOCK_BYTES, MANY = 2 << 20, 1 << 20, 2000
#: Portions of rows by which hot keys of a join are dealt, and rows of a portion at least.
PORTIONS, LEAST_PORTION = 10_000, 1000
#: Places whose keys fit 24 bits.
SLICE = (1 << 24) - LENGTH

_U64 = np.uint64


def _least_ahead(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive keys."""
    out, have = keys, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Pieces:
    """The pieces of a buffer of texts: document, first string, number of strings, anchor hash and content hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        none = np.zeros(0, np.int64)
        self.doc = self.start = self.strings = none
        self.anchor = self.content = np.zeros(0, _U64)
        width = LENGTH - ANCHOR + 1
        if len(data) < LENGTH:
            return
        hashes = RangeHash(data, 21)
        seed = mixed(hashes.windows(ANCHOR))
        owner = np.empty(len(seed) - width + 1, np.int64)
        for lo in range(0, len(owner), SLICE):
            # 40 bits of the hash, then the place: the least key is the leftmost of the least hashes
            part = seed[lo : lo + SLICE + width - 1]
            least = _least_ahead((part >> _U64(24) << _U64(24)) | np.arange(len(part), dtype=_U64), width)
            owner[lo : lo + SLICE] = lo + (least & _U64((1 << 24) - 1)).astype(np.int64)
        # strings that lie in one document
        ends = np.repeat(offsets[1:], np.diff(offsets))
        at = np.flatnonzero(np.arange(len(owner)) + LENGTH <= ends[: len(owner)])
        if not len(at):
            return
        owner = owner[at]
        doc = np.searchsorted(offsets, at, "right") - 1
        new = np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(doc) != 0)))
        first = np.flatnonzero(new)
        self.start = at[first]
        self.strings = np.diff(np.concatenate((first, [len(at)])))
        self.doc = doc[first]
        self.anchor = seed[owner[first]]
        end = self.start + self.strings - 1 + LENGTH
        self.content = mixed(hashes.of(self.start, end) ^ ((owner[first] - self.start) * 1024 + self.strings).astype(_U64))


def _batches_of_pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, Pieces]]:
    data, offsets = text_bytes(batch.column("text"))
    for lo, hi in row_ranges(np.diff(offsets), CHUNK):
        part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        yield lo, part, offs, Pieces(part, offs)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, n): anchors by hash, summed over a buffer."""
    for batch in batches:
        for _, _, _, p in _batches_of_pieces(batch):
            anchor, n = np.unique(p.anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n, pa.int64())], names=["anchor", "n"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, content, key, tag, start, strings) of every piece; key and tag tell its row."""
    for batch in batches:
        keys, tags = (batch.column(c).to_numpy() for c in ("key", "tag"))
        for lo, _, offsets, p in _batches_of_pieces(batch):
            rows = p.doc + lo
            arrays = [p.anchor.view(np.int64), p.content.view(np.int64), keys[rows], tags[rows], (p.start - offsets[p.doc]).astype(np.int64), p.strings.astype(np.int32)]
            for at in range(0, max(1, len(rows)), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in arrays], names=["anchor", "content", "key", "tag", "start", "strings"])


_PIECES = "anchor long, content long, key long, tag long, start long, strings int"


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array of pieces laid end to end; each suffix ends with its piece, and equal ones are in text order.

    text: bytes; ends: for each position, the end of its piece.  Ranks by 7 bytes at once (with how many there were), then by doubling.
    """
    n = len(text)
    left = ends - np.arange(n)
    key = np.zeros(n, _U64)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(_U64)
    for j in range(7):
        key = (key << _U64(8)) | np.where(left > j, padded[j : n + j], _U64(0))
    key = (key << _U64(8)) | np.minimum(left, 7).astype(_U64)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    rank = np.empty(n, np.int64)
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank[order] = np.cumsum(new)
    have, longest = 7, int(left.max(initial=0))
    while have < longest and not new.all():
        # only ties move: among equal ranks, by the rank of what follows
        tied = ~(new & np.concatenate((new[1:], [True])))
        rows = order[tied]
        follow = np.where(left[rows] > have, rank[np.minimum(rows + have, n - 1)], 0)
        pair = rank[rows] * (n + 1) + follow
        resorted = np.argsort(pair, kind="stable")
        order[tied] = rows[resorted]
        sorted_pair = pair[resorted]
        changed = np.concatenate(([True], sorted_pair[1:] != sorted_pair[:-1]))
        new[np.flatnonzero(tied)] = changed | new[np.flatnonzero(tied)]
        rank[order] = np.cumsum(new)
        have *= 2
    return order


class RunLengthIndex:
    """The run-length compressed Burrows-Wheeler transform of pieces, with samples at both ends of its runs."""

    def __init__(self, text: np.ndarray, starts: np.ndarray):
        """starts: where each piece begins, in order."""
        n = len(text)
        self.text = text
        sizes = np.diff(np.concatenate((starts, [n])))
        self.ends = np.repeat(starts + sizes, sizes)
        order = suffix_order(text, self.ends)
        # what precedes a suffix; what precedes a whole piece is unlike all else
        before = text[order - 1].astype(np.int32)
        begins = np.zeros(n, bool)
        begins[starts] = True
        before[begins[order]] = 256
        same = (before[1:] == before[:-1]) & (before[1:] != 256)
        self.run_start = np.flatnonzero(np.concatenate(([True], ~same)))
        self.run_letter = before[self.run_start]
        heads = self.run_start[self.run_start > 0]
        # at a run's start the neighbour before, at its end the neighbour after
        self.head = (order[heads], order[heads - 1], order[:1])
        self.tail = (order[heads - 1], order[heads], order[-1:])

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, by eight bytes at once."""
        most = np.minimum(self.ends[a] - a, self.ends[b] - b)
        padded = np.concatenate((self.text, np.zeros(8, np.uint8)))
        words = np.lib.stride_tricks.sliding_window_view(padded, 8)
        out = np.zeros(len(a), np.int64)
        open_ = np.arange(len(a))
        while len(open_):
            x = np.ascontiguousarray(words[a[open_] + out[open_]]).view("<u8").ravel()
            y = np.ascontiguousarray(words[b[open_] + out[open_]]).view("<u8").ravel()
            differ = x ^ y
            low = differ & (~differ + _U64(1))
            same = np.where(differ == 0, 8, np.log2(np.maximum(low, _U64(1)).astype(np.float64)).astype(np.int64) >> 3)
            out[open_] += same
            open_ = open_[(same == 8) & (out[open_] < most[open_])]
        return np.minimum(out, most)

    def matching_statistics(self) -> np.ndarray:
        """For each position, the length of the longest match with any other position, streamed from the samples."""
        n = len(self.text)
        best = np.zeros(n, np.int64)
        for at, neighbour, alone in (self.head, self.tail):
            reach = np.zeros(n, np.int64)  # where the match that is carried on ends
            length = self._match(at, neighbour)
            sampled = np.zeros(n, bool)
            sampled[at] = True
            reach[at] = at + length
            # the first suffix has no neighbour before, the last none after
            sampled[alone], reach[alone] = True, alone
            # the last sample at or before each position carries on
            last = np.maximum.accumulate(np.where(sampled, np.arange(n), -1))
            carried = np.where(last >= 0, reach[np.maximum(last, 0)], 0) - np.arange(n)
            best = np.maximum(best, carried)
        return np.minimum(np.maximum(best, 0), self.ends - np.arange(n))


def _index_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, content, lo, hi): which strings of each piece repeat in its block.  Rows come sorted by block."""
    held: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
    block = None

    def flush() -> Iterator[pa.RecordBatch]:
        anchor, content = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        pieces = [x for h in held for x in h[2]]
        held.clear()
        sizes = np.array([len(x) for x in pieces], np.int64)
        starts = np.cumsum(sizes) - sizes
        statistics = RunLengthIndex(np.frombuffer(b"".join(pieces), np.uint8), starts).matching_statistics()
        hit = np.concatenate(([0], (statistics >= LENGTH).astype(np.int8), [0]))
        edge = np.diff(hit)
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # a run of repeating strings can't cross pieces: the last 199 places of a piece start no string
        piece = np.searchsorted(starts, lo, "right") - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[piece]), pa.array(content[piece]), pa.array((lo - starts[piece]).astype(np.int32)), pa.array((hi - starts[piece]).astype(np.int32))],
            names=["anchor", "content", "lo", "hi"],
        )

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        anchor, content = (batch.column(c).to_numpy() for c in ("anchor", "content"))
        pieces = batch.column("piece").to_pylist()
        for part in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1):
            if len(part):
                if block is not None and blocks[part[0]] != block and held:
                    yield from flush()
                block = blocks[part[0]]
                held.append((anchor[part], content[part], pieces[part[0] : part[-1] + 1]))
    if held:
        yield from flush()


_RANGES = "anchor long, content long, lo int, hi int"


def _string_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, content, at, s1, s2): two hashes of each string of a piece."""
    for batch in batches:
        anchor, content = (batch.column(c).to_numpy() for c in ("anchor", "content"))
        data, offsets = text_bytes(batch.column("piece"))
        for lo, hi in row_ranges(np.diff(offsets), CHUNK):
            part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            one, two = (mixed(RangeHash(part, seed).windows(LENGTH)) for seed in (31, 32))
            strings = np.diff(offs) - LENGTH + 1
            piece = np.repeat(np.arange(hi - lo), strings)
            at = np.arange(len(piece)) - np.repeat(np.cumsum(strings) - strings, strings)
            where = offs[piece] + at
            columns = (anchor[lo + piece], content[lo + piece], at.astype(np.int32), one[where].view(np.int64), two[where].view(np.int64))
            for k in range(0, max(1, len(at)), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in columns], names=["anchor", "content", "at", "s1", "s2"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted pieces of each text: rows (text, wanted: array of (anchor, content, many, start, strings))."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        raw = memoryview(data)
        wanted = batch.column("wanted")
        doc = np.repeat(np.arange(len(wanted)), np.asarray(wanted.value_lengths().fill_null(0)))
        fields = {f: x.to_numpy(zero_copy_only=False) for f, x in zip(("anchor", "content", "many", "start", "strings"), wanted.flatten().flatten(), strict=True)}
        begin = offsets[doc] + fields["start"]
        end = begin + fields["strings"] - 1 + LENGTH
        for k in range(0, max(1, len(doc)), 20_000):
            s = slice(k, k + 20_000)
            pieces = [bytes(raw[a:b]) for a, b in zip(begin[s], end[s], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(fields[f][s]) for f in ("anchor", "content", "many")), pa.array(pieces, pa.binary())], names=["anchor", "content", "many", "piece"])


def _join_counted(rows: DataFrame, counted: DataFrame, on: list[str], spread: list[str]) -> DataFrame:
    """rows joined with counted, a table with one row a key and n, the key's number of rows (dropped).

    A key's rows are dealt in portions of a ten-thousandth of all rows, by the columns `spread`.  Keys of more than one portion are few,
    10,000 at most, so their list is broadcast; their rows of counted are copied once a portion, which makes 20,000 copies at most.
    """
    portion = max((counted.agg(F.sum("n")).first()[0] or 0) / PORTIONS, LEAST_PORTION)
    portions = F.ceil(F.col("n") / portion)
    hot = F.broadcast(counted.filter(F.col("n") > portion).select(*on, portions.alias("_portions")))
    dealt = rows.join(hot, on, "left").withColumn("_portion", F.when(F.col("_portions").isNotNull(), F.pmod(F.xxhash64(*spread), "_portions")).otherwise(0)).drop("_portions")
    copies = counted.withColumn("_portion", F.explode(F.sequence(F.lit(0).cast("long"), portions - 1))).drop("n")
    return dealt.join(copies, [*on, "_portion"]).drop("_portion")


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(key, tag, spans: array<struct<lo, hi>>) of texts (key long, tag long, text binary): the bytes of each row's text that a repeated
    string covers.  Rows that agree in key, tag and text share their spans."""
    session = texts.sparkSession
    parts = max(1, int(session.conf.get("spark.sql.shuffle.partitions")))
    anchors = texts.select("text").mapInArrow(_anchors, "anchor long, n long")
    often = stash(anchors.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1"))
    pieces = stash(_join_counted(texts.mapInArrow(_pieces, _PIECES), often, ["anchor"], ["key", "tag", "start"]))
    rep = F.struct("key", "tag", "start", "strings")
    kinds = stash(pieces.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(rep).alias("rep")))
    variants = stash(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("many", F.col("n") > MANY))
    several = stash(_join_counted(kinds.select("anchor", "content", "rep"), variants, ["anchor"], ["content"]).select("anchor", "content", "many", "rep.*"))
    wanted = several.groupBy("key", "tag").agg(F.collect_list(F.struct("anchor", "content", "many", "start", "strings")).alias("wanted"))
    # rows that repeat hold the same text: the pieces of any one do
    found = texts.join(wanted, ["key", "tag"]).select("text", "wanted").mapInArrow(_cut, "anchor long, content long, many boolean, piece binary")
    cut = stash(found.dropDuplicates(["anchor", "content"]))
    total = several.filter(~F.col("many")).agg(F.sum(F.col("strings") + LENGTH)).first()[0] or 0
    n_blocks = max(parts, -(-int(total) // BLOCK_BYTES))
    # at most MANY pieces of an anchor come together
    dealt = cut.filter(~F.col("many")).withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(n_blocks))).repartition(n_blocks, "block").sortWithinPartitions("block")
    indexed = dealt.select("block", "anchor", "content", "piece").mapInArrow(_index_blocks, _RANGES)
    strings = stash(cut.filter("many").select("anchor", "content", "piece").mapInArrow(_string_hashes, "anchor long, content long, at int, s1 long, s2 long"))
    again = stash(strings.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    counted = _join_counted(strings, again, ["s1", "s2"], ["content", "at"]).select("anchor", "content", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))
    # pieces that occur more than once repeat as a whole; of others, the ranges of their strings (169 at most)
    ranges = indexed.unionByName(counted).groupBy("anchor", "content").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.col("rep.strings").alias("hi")))
    marked = kinds.join(ranges, ["anchor", "content"], "left").select("anchor", "content", "n", F.when(F.col("n") > 1, whole).otherwise(F.col("ranges")).alias("ranges")).filter("ranges IS NOT NULL")
    hits = _join_counted(pieces, stash(marked), ["anchor", "content"], ["key", "tag", "start"]).select("key", "tag", "start", F.explode("ranges").alias("r"))
    spans = F.struct((F.col("start") + F.col("r.lo")).alias("lo"), (F.col("start") + F.col("r.hi") - 1 + LENGTH).alias("hi"))
    return hits.groupBy("key", "tag").agg(F.collect_set(spans).alias("spans"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n_bytes, n_removed, n_spans, kept) of rows (text, spans)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        raw = memoryview(data)
        spans = batch.column("spans")
        lo, hi = (x.to_numpy() for x in spans.flatten().flatten())
        ends = np.concatenate(([0], np.cumsum(np.asarray(spans.value_lengths().fill_null(0)))))
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for i in range(len(spans)):
            text = raw[offsets[i] : offsets[i + 1]]
            a, b = lo[ends[i] : ends[i + 1]], hi[ends[i] : ends[i + 1]]
            kept, at, removed, runs = [], 0, 0, 0
            if len(a):
                order = np.argsort(a, kind="stable")
                a, reach = a[order], np.maximum.accumulate(b[order])
                # spans that touch or overlap are one
                new = np.flatnonzero(np.concatenate(([True], a[1:] > reach[:-1])))
                starts, stops = a[new], reach[np.concatenate((new[1:] - 1, [len(a) - 1]))]
                runs, removed = len(starts), int((stops - starts).sum())
                for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
                    kept.append(text[at:s])
                    at = e
            kept.append(text[at:])
            out["n_bytes"].append(len(text))
            out["n_removed"].append(removed)
            out["n_spans"].append(runs)
            out["kept"].append(b"".join(kept))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c not in ("text", "spans")), *(pa.array(out[c], pa.binary() if c == "kept" else pa.int64()) for c in out)], names=[*(c for c in batch.schema.names if c not in ("text", "spans")), *out])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _remove(batches):
        at = batch.schema.get_field_index("kept")
        digests = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("kept")], pa.string())
        yield batch.set_column(at, "kept_sha256", digests)


def _joined(docs: DataFrame, key: str, text: str, without: list[str]) -> DataFrame:
    """docs' rows as (_row, text binary, spans)."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    keyed = docs.select(whole_row(docs, without), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64(raw).alias("tag"), raw.alias("text"))
    spans = repeated_ranges(keyed.select("key", "tag", "text"))
    return keyed.join(spans, ["key", "tag"], "left").select("_row", "text", F.coalesce("spans", F.array().cast("array<struct<lo:bigint,hi:bigint>>")).alias("spans"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed runs) long and kept binary, the bytes that stay.

    Texts are UTF-8 bytes, null is empty; a byte goes if a 200-byte string covers it that also starts anywhere else in any text, its own
    included.  Strings are judged on the input, so of two copies both go.  What stays need not be valid UTF-8.  Repeated rows and null
    keys are rows like others.  Columns of docs with the names of the added ones are replaced, and the text column isn't changed.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    rows = _joined(docs, key, text, added)
    shape = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(_remove, f"_row {shape}, n_bytes long, n_removed long, n_spans long, kept binary").select("_row.*", *added)


def repeat_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of each row: remove_repeats() with a digest of what stays."""
    rows = _joined(docs.select(key, text), key, text, [text])
    shape = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(_digest, f"_row {shape}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").select("_row.*", "n_bytes", "n_removed", "n_spans", "kept_sha256")
