"""Near-duplicate classes by ProbMinHash signatures of weighted word shingles, banding and exact verification.

A shingle's weight is its count in the text.  Each shingle is a Poisson process whose rate is its weight; its arrivals fall on random
registers, and a register keeps the first arrival of all shingles.  Two texts agree in a register with the probability Jaccard
similarity of their weights (the plain Jaccard similarity if no shingle repeats).  A shingle's process ends as soon as its next arrival
comes after the latest of the registers, since it can't change them any more.

Candidates are texts that agree in all registers of a band.  Rather than all pairs of a bucket, each member is verified against the
bucket's hub, the member with the largest buckets: among edited copies that is the text which the others stem from.  Members that are
still in different classes after that are compared block by block: first the pair of each member with the highest estimate is
verified, if that may reach the threshold, then, between what is still apart, all pairs, inside the tasks that compare two blocks, which
return links only.  So no link of a candidate pair is lost to the shortcut, and no pairs of a bucket are listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import RangeHash, clear, mixed, release, row_ranges, stash, whole_row
from tesela.llm.components import connected_components

#: Bands and registers in each: at similarity 0.8, two texts share a band with probability 0.9993.
BANDS, ROWS = 24, 6
#: Registers of a signature; bands take the first, estimates all.
REGISTERS = 384
#: Words in a shingle, least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Least estimate at which a pair is verified before the last round: three standard errors (of 384 registers) under the least similarity.
ESTIMATE = 0.739
#: Least estimate at which the last round compares texts: a similar pair falls under it as rarely as 64-bit hashes collide (nine errors).
CERTAIN = 0.6
#: Members in a block of a bucket, without and with their texts; likeliest partners of a member in each block that are verified first.
BLOCK, TEXTS, LIKELIEST = 256, 128, 1
#: Bytes of text that are worked on at once, and bytes of pairs of texts (most texts are in several pairs).
CHUNK, PAIRS_CHUNK = (1 << 20) - 1, 4 << 20
#: Arrivals that are drawn at once after the first two of each shingle; bytes that a text counts at least, for its registers.
WIDE, LEAST = 200_000, 2000

_U64 = np.uint64
_GOLDEN = _U64(0x9E3779B97F4A7C15)


def _power(k: int) -> np.uint64:
    """An odd constant to the k, modulo 2**64."""
    return _U64(pow(int(_GOLDEN), k, 1 << 64))


def _letters() -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[lo:hi] = True
    return table


_LETTER = _letters()


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of each distinct shingle of a buffer of lower-cased texts, by document.

    Words are runs of ASCII letters, digits and bytes of other scripts.  A text of fewer words than a shingle has one shingle of them all;
    a text without words has none.
    """
    inside = _LETTER[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = inside[firsts]
    ends[firsts[1:] - 1] = inside[firsts[1:] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, _U64), np.zeros(0, np.int64)
    word = mixed(RangeHash(data, 11).of(start, end) ^ (end - start).astype(_U64))
    owner = np.searchsorted(offsets, start, "right") - 1
    n = np.bincount(owner, minlength=len(offsets) - 1)
    h = np.zeros(len(word), _U64)
    # a shingle is the sum of its words' hashes, each times a power of an odd constant
    total = len(word)
    for j in range(min(words, total)):
        h[: total - j] += word[j:] * _power(j)
    place = np.arange(total) - (np.cumsum(n) - n)[owner]
    whole = place + words <= n[owner]
    short = (n[owner] < words) & (place == 0)
    if short.any():
        for i in np.flatnonzero(short):
            own = word[i : i + n[owner[i]]]
            h[i] = (own * np.array([_power(j) for j in range(len(own))], _U64)).sum() + _U64(len(own))
    keep = np.flatnonzero(whole | short)
    owner, h = owner[keep], mixed(h[keep])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.concatenate(([True], (np.diff(owner) > 0) | (h[1:] != h[:-1])))
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.concatenate((at, [len(h)])))


def prob_minhash(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The signatures (n, registers) of n weighted sets; sets without elements have zeros.

    An arrival's time and register depend on its element and its number alone, and times add up one by one, so a set has the same
    signature whatever sets are signed beside it and however many arrivals are drawn at once.
    """
    first, taken = np.full(n * registers, np.inf), []
    at, passed, t, step = np.arange(len(h)), np.zeros(len(h)), 0, 1
    while len(at):
        count = (np.arange(step, dtype=_U64) + _U64(t + 1))[None, :] * _GOLDEN
        bits = mixed(h[at][:, None] + count)
        gaps = -np.log1p(-((bits >> _U64(11)).astype(np.float64) * 2.0**-53))
        gaps[:, 0] += passed[at]
        waited = np.cumsum(gaps, axis=1)
        x = waited / weight[at][:, None]
        where = owner[at][:, None] * registers + (mixed(bits + _GOLDEN) % _U64(registers)).astype(np.int64)
        won = x < first[where]
        w, v = where[won], x[won]
        np.minimum.at(first, w, v)
        hit = v == first[w]
        taken.append((w[hit], v[hit], np.broadcast_to(h[at][:, None], x.shape)[won][hit]))
        passed[at] = waited[:, -1]
        latest = first.reshape(n, registers).max(1)
        at = at[x[:, -1] < latest[owner[at]]]
        t += step
        step = 1 if t < 2 else max(1, min(32, WIDE // max(1, len(at))))
    out = np.zeros(n * registers, _U64)
    for w, v, value in taken:
        last = v == first[w]
        out[w[last]] = value[last]
    return out.reshape(n, registers)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, key, bands, sig) of each text with shingles; without, bands is empty.  sig: 16 bits of each register."""
    for batch in batches:
        texts, keys = batch.column("text").to_pylist(), batch.column("key")
        raw = [(x or "").encode() for x in texts]
        sizes = np.array([len(x) for x in raw], np.int64)
        for lo, hi in row_ranges(np.maximum(sizes, LEAST), CHUNK):
            lowered = [(x or "").lower().encode() for x in texts[lo:hi]]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lowered]))).astype(np.int64)
            owner, h, weight = weighted_shingles(np.frombuffer(b"".join(lowered), np.uint8), offsets)
            have = np.unique(owner)
            index = np.searchsorted(have, owner)
            sig = prob_minhash(index, h, weight.astype(np.float64), len(have), REGISTERS)
            bands = np.zeros((len(have), BANDS), _U64)
            for r in range(ROWS):
                bands += sig[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)[:, :, r] * _power(r)
            bands = mixed(bands + np.arange(BANDS, dtype=_U64)[None, :] * _U64(0xD1B54A32D192ED03)).view(np.int64)
            short = np.zeros((hi - lo, REGISTERS), np.uint16)
            short[have] = (sig & _U64(0xFFFF)).astype(np.uint16)
            counts = np.zeros(hi - lo, np.int64)
            counts[have] = BANDS
            arrays = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(bands.ravel()))
            tids = pa.array([hashlib.md5(x).digest() for x in raw[lo:hi]], pa.binary())
            yield pa.RecordBatch.from_arrays([tids, keys.slice(lo, hi - lo), arrays, pa.array([x.tobytes() for x in short], pa.binary())], names=["tid", "key", "bands", "sig"])
        release()


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = 0.0) -> float:
    """Exact probability Jaccard similarity of two weighted sets, given as (sorted hashes, weights); 0 if it is certain to be under least."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    common = b[0][at] == a[0]
    x, y = a[1][common], b[1][at[common]]
    n, total_a, total_b = len(x), a[1].sum(), b[1].sum()
    if total_a == len(a[0]) and total_b == len(b[0]):
        return n / (len(a[0]) + len(b[0]) - n)  # no weight but 1: the plain Jaccard similarity
    # no element adds more than its share of either set
    if np.minimum(x / total_a, y / total_b).sum() < least:
        return 0.0
    only_a, only_b = total_a - x.sum(), total_b - y.sum()
    pairs, times = np.unique(np.stack((x, y), 1), axis=0, return_counts=True)
    u, v = pairs[:, 0], pairs[:, 1]
    total = 0.0
    for i, n in enumerate(times):
        total += n / ((times * np.maximum(u / u[i], v / v[i])).sum() + only_a / u[i] + only_b / v[i])
    return total


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the candidate pairs that are similar.  The texts of some rows are turned into weighted sets together, each once."""
    for batch in batches:
        tids = (batch.column("a").to_pylist(), batch.column("b").to_pylist())
        columns = (batch.column("text_a"), batch.column("text_b"))
        sizes = np.asarray(pc.binary_length(columns[0])).astype(np.int64) + np.asarray(pc.binary_length(columns[1]))
        out: tuple[list[bytes], list[bytes]] = ([], [])
        for lo, hi in row_ranges(sizes, PAIRS_CHUNK):
            place: dict[bytes, int] = {}
            lowered = []
            for side, column in zip(tids, columns, strict=True):
                for i in range(lo, hi):
                    if side[i] not in place:
                        place[side[i]] = len(lowered)
                        lowered.append(column[i].as_py().lower().encode())
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lowered]))).astype(np.int64)
            owner, h, weight = weighted_shingles(np.frombuffer(b"".join(lowered), np.uint8), offsets)
            weight = weight.astype(np.float64)
            cut = np.searchsorted(owner, np.arange(len(lowered) + 1))
            for a, b in zip(tids[0][lo:hi], tids[1][lo:hi], strict=True):
                i, j = place[a], place[b]
                one, two = slice(cut[i], cut[i + 1]), slice(cut[j], cut[j + 1])
                if probability_jaccard((h[one], weight[one]), (h[two], weight[two]), SIMILARITY - 1e-9) >= SIMILARITY - 1e-12:
                    out[0].append(a)
                    out[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["a", "b"])
        release()


def _members(blocks: pa.ListScalar) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(tids, classes, registers, bands, texts) of a block."""
    rows = blocks.as_py()
    roots, bands = np.array([x["root"] for x in rows], dtype=object), np.array([x["bands"] for x in rows], np.int64)
    return [x["tid"] for x in rows], roots, np.frombuffer(b"".join(x["sig"] for x in rows), np.uint16).reshape(len(rows), -1), bands, [x.get("text") for x in rows]


def _partners(i: int, at: int, left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(places in right, estimates) of the members of other classes than left's i-th, best first.  A pair that shares several bands is told
    in the first of them, at, only."""
    hits = np.flatnonzero(right[1] != left[1][i])
    hits = hits[~(right[3][hits, :at] == left[3][i, :at]).any(1)]
    alike = (right[2][hits] == left[2][i]).mean(1)
    best = np.argsort(-alike, kind="stable")
    return hits[best], alike[best]


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, tuple]]:
    for batch in batches:
        for at, left, right in zip(batch.column("at").to_pylist(), batch.column("l"), batch.column("r"), strict=True):
            yield at, _members(left), _members(right)


def _likely_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of two blocks, rows (at, l, r) of member lists: each member of l with its likeliest partners of other classes in r."""
    for at, left, right in _block_pairs(batches):
        out: tuple[list[bytes], list[bytes]] = ([], [])
        for i, tid in enumerate(left[0]):
            hits, alike = _partners(i, at, left, right)
            for j in hits[:LIKELIEST][alike[:LIKELIEST] >= ESTIMATE].tolist():
                out[0].append(max(tid, right[0][j]))
                out[1].append(min(tid, right[0][j]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["a", "b"])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): similar pairs of two blocks, enough to join all classes that have one.

    Every pair whose classes are still different is verified here, in the task, so only links leave it: fewer than its members.
    """
    for at, left, right in _block_pairs(batches):
        texts = [(t or "").lower().encode() for t in (*left[4], *right[4])]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
        owner, h, weight = weighted_shingles(np.frombuffer(b"".join(texts), np.uint8), offsets)
        cut, weight = np.searchsorted(owner, np.arange(len(texts) + 1)), weight.astype(np.float64)
        sets = [(h[cut[k] : cut[k + 1]], weight[cut[k] : cut[k + 1]]) for k in range(len(texts))]
        joined: dict[bytes, bytes] = {}

        def top(root: bytes, joined: dict[bytes, bytes] = joined) -> bytes:
            while root in joined:
                root = joined[root]
            return root

        out: tuple[list[bytes], list[bytes]] = ([], [])
        for i, tid in enumerate(left[0]):
            hits, alike = _partners(i, at, left, right)
            for j in hits[alike >= CERTAIN].tolist():
                mine, other = top(left[1][i]), top(right[1][j])
                if mine != other and probability_jaccard(sets[i], sets[len(left[0]) + j], SIMILARITY - 1e-9) >= SIMILARITY - 1e-12:
                    joined[max(mine, other)] = min(mine, other)
                    out[0].append(max(tid, right[0][j]))
                    out[1].append(min(tid, right[0][j]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["a", "b"])
        release()


def _still_apart(members: DataFrame, roots: DataFrame, sigs: DataFrame, run, block: int, made: list[str]) -> DataFrame:
    """(a, b): what run() finds in the pairs of blocks of members of one bucket that are in different classes; sigs: what it needs of them."""
    placed = members.join(roots.select(F.col("node").alias("tid"), "root"), "tid", "left").select("band", "at", "tid", "hub", F.coalesce("root", "tid").alias("root"))
    main = placed.filter(F.col("tid") == F.col("hub")).select("band", F.col("root").alias("main"))
    sizes = placed.join(main, "band").groupBy("band").agg(F.min("main").alias("main"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("root") != F.col("main")).alias("others")).filter("others > 0")
    apart = placed.join(sizes, "band").join(sigs, "tid").withColumn("other", F.col("root") != F.col("main"))
    # of a bucket's members outside its hub's class, and of those inside, blocks of about that many
    blocks = F.ceil(F.when(F.col("other"), F.col("others")).otherwise(F.col("n") - F.col("others")) / block)
    dealt = apart.withColumn("block", F.pmod(F.xxhash64("tid"), blocks))
    kept = dealt.groupBy("band", "at", "other", "block").agg(F.collect_list(F.struct("tid", "root", *[c for c in sigs.columns if c != "tid"])).alias("rows"), F.first("n").alias("n"), F.first("others").alias("others"))
    packed = stash(kept, made)
    # each block goes to the pairs of blocks that it is part of, which are keys of their own: a bucket's pairs are dealt over the cluster
    last = F.ceil(F.col("others") / block) - 1
    inside = F.ceil((F.col("n") - F.col("others")) / block) - 1
    met = F.sequence("block", last)
    left = packed.filter("other").withColumn("pair", F.explode(F.concat(F.transform(met, lambda b: F.struct(F.lit(True).alias("other"), b.alias("r"))), F.transform(F.sequence(F.lit(0).cast("long"), inside), lambda b: F.struct(F.lit(False).alias("other"), b.alias("r"))))))
    left = left.select("band", "at", F.col("pair.other").alias("other"), F.col("block").alias("l_block"), F.col("pair.r").alias("r_block"), F.col("rows").alias("l"))
    meets = F.when(F.col("other"), F.sequence(F.lit(0).cast("long"), "block")).otherwise(F.sequence(F.lit(0).cast("long"), last))
    right = packed.select("band", "other", F.explode(meets).alias("l_block"), F.col("block").alias("r_block"), F.col("rows").alias("r"))
    pairs = left.join(right, ["band", "other", "l_block", "r_block"])
    return pairs.select("at", "l", "r").mapInArrow(run, "a binary, b binary").distinct()


def _links(pairs: DataFrame, texts: DataFrame, made: list[str]) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    with_a = pairs.join(texts.select(F.col("tid").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("tid").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return stash(both.mapInArrow(_verify, "a binary, b binary"), made)


def _classified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """near_classes() with the column _root, which tells classes apart even where their keys are null."""
    added = ["class_id", "class_size", "kept", "_root"]
    spark, made = docs.sparkSession, []
    keyed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    signed = keyed.mapInArrow(_signatures, "tid binary, key long, bands array<long>, sig binary")
    # equal texts are one from here on
    distinct = stash(signed.groupBy("tid").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), made)
    banded = distinct.select("tid", F.posexplode("bands").alias("at", "band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = stash(banded.join(shared, "band"), made)
    weighed = buckets.join(buckets.groupBy("tid").agg(F.sum("n").alias("weight")), "tid")
    hubs = weighed.groupBy("band").agg(F.max(F.struct("weight", "tid"))["tid"].alias("hub"))
    members = stash(buckets.select("band", "at", "tid").join(hubs, "band"), made)
    first = stash(members.filter(F.col("tid") != F.col("hub")).select(F.greatest("tid", "hub").alias("a"), F.least("tid", "hub").alias("b")).distinct(), made)
    # the texts of candidates only, one of each
    wanted = members.select("tid").distinct().join(distinct.select("tid", "key"), "tid")
    own = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # a text's smallest key finds it, and its digest tells it from other rows of that key
    found = own.join(wanted, own.key.eqNullSafe(wanted.key)).filter(F.unhex(F.md5("text")) == F.col("tid"))
    texts = stash(found.select("tid", "text").dropDuplicates(["tid"]), made)
    links = _links(first, texts, made)
    roots = connected_components(links, made)
    # first the likeliest pairs, then whatever is still in different classes
    sigs = distinct.select("tid", "sig", "bands")
    likely = stash(_still_apart(members, roots, sigs, _likely_pairs, BLOCK, made).join(first, ["a", "b"], "left_anti"), made)
    for step in (lambda: _links(likely, texts, made), lambda: stash(_still_apart(members, roots, sigs.join(texts, "tid"), _block_links, TEXTS, made), made)):
        more = step()
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = connected_components(links, made)
    classes = distinct.select("tid", "key", "n").join(roots.select(F.col("node").alias("tid"), "root"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    sizes = classes.groupBy("root").agg(F.min("key").alias("class_id"), F.sum("n").alias("class_size"))
    by_text = stash(classes.join(sizes, "root").select("tid", "class_id", "class_size", F.col("root").alias("_root")))
    clear(spark, made)
    rows = docs.select(whole_row(docs, added), F.col(key).alias("_key"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("tid"))
    kept = F.col("_key").eqNullSafe(F.col("class_id")).alias("kept")
    return rows.join(by_text, "tid").select("_row.*", "class_id", "class_size", kept, "_root")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with class_id (the smallest key of the class), class_size (its rows) and kept (the row of that key).

    Two texts link when the probability Jaccard similarity of their five-word shingles, weighted by count, is 0.8 or more; classes are
    the connected components of links, equal texts being of one class.  Words are lower-cased runs of letters and digits.  Null counts as
    empty; texts without words link to nothing but equal texts.  A null key is the class's only if all its keys are null.  Rows that
    share the smallest key are all kept; drop_near_copies() keeps one.  Columns of docs with the names of the added ones are replaced.
    """
    return _classified(docs, key, text).drop("_root")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' columns: one of each class."""
    kept = _classified(docs, key, text).filter("kept")
    # rows of one class may share its smallest key, null too
    return kept.dropDuplicates(["_root"]).select(*[F.col(f"`{c}`") for c in docs.columns])
