"""The first k chunks of fused rankings, exactly, without ranking the corpus for each question.

One question: a chunk's fused score is 1 / (60 + lexical rank) + 1 / (60 + vector rank).  The first k of the lexical ranking score at least
1 / (59 + k) each, and a chunk beyond place P = 60 + 2k in both rankings at most 2 / (60 + P) = 1 / (60 + k), so the first k are among
the first P of either.  The ranks of these few in the other ranking are counted: each task counts which of its chunks come before each,
and the counts are summed.

Several questions: the second fusion adds 1 / (60 + place) over the questions' fused rankings, so every place counts.  A threshold
algorithm reads both rankings of each question down to a depth.  Ranks within it are known, those beyond lie between it and the size of the
corpus, which bounds each fused place and each sum, also of chunks not met yet.  A group is done once its first k are apart from each other
and from all others, and their sums are known to six places; the others are read deeper, at most down to the end, where all is known.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesela.operators import blocks as blocks_of
from tesela.operators import fusion
from tesela.operators.blocks import Asked, Best, Blocks, arrow_type, firsts, meet, opened
from tesela.operators.vectors import dot, norm
from tesela.sources.stage import give_back, staged

#: Places of each ranking that the threshold algorithm reads first, and how many times as many it reads next.
DEPTH, DEEPER = 1 << 20, 8
#: How many times as many blocks a sample has as the one before.
WIDER = 4

_FLOORS = ("floor_score", "floor_number", "floor_distance", "floor_at")


def _floors(asked: Asked) -> list[np.ndarray]:
    """Each question's least (score, number) and greatest (distance, number) of interest; open where it has none."""
    if "floor_score" not in [f.name for f in asked.rows.type]:
        n = len(asked.keys)
        return [np.full(n, x) for x in (-np.inf, np.inf, np.inf, np.inf)]
    return [asked.column(c, d) for c, d in zip(_FLOORS, (-np.inf, 2**62, np.inf, 2**62), strict=True)]


def _candidates(most: int, kind: pa.DataType):
    """(query_id, chunk_id, number, score, distance): a task's first places of each question in either ranking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, Asked] = {}
        best: dict = {}
        for batch in batches:
            for block in opened(batch, cache):
                distances, numbers, ids = block.distances(), block.numbers(), block.chunk_ids()
                low, low_at, far, far_at = _floors(block.asked)
                for q, key in enumerate(block.asked.keys):
                    score, _ = block.scores(q)
                    d = distances[q]
                    by_words = np.flatnonzero((score > low[q]) | ((score == low[q]) & (numbers <= low_at[q])))
                    by_vector = np.flatnonzero((d < far[q]) | ((d == far[q]) & (numbers <= far_at[q])))
                    for mine, keys, hit in zip(best.setdefault(key, (Best(most), Best(most))), (-score, d), (by_words, by_vector), strict=True):
                        hit = firsts(keys, most, hit)
                        hit = hit[keys[hit] <= mine.worst]
                        if len(hit):
                            mine.add(keys[hit], numbers[hit], [ids.take(pa.array(hit)), pa.array(score[hit]), pa.array(d[hit])])
        for key, lists in best.items():
            lists = [b for b in lists if len(b.keys)]
            if lists:
                numbers, at = np.unique(np.concatenate([b.numbers for b in lists]), return_index=True)
                ids, score, d = (pa.concat_arrays(x).take(pa.array(at)) for x in zip(*[b.rest for b in lists], strict=True))
                d = d.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(numbers), kind), ids, pa.array(numbers), score, pa.array(d, mask=np.isnan(d))], names=["query_id", "chunk_id", "number", "score", "distance"])
        give_back()

    return run


def _before(keys: np.ndarray, numbers: np.ndarray, marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many (key, number) come before each mark (key, number); NaN keys before none."""
    return ((keys[None, :] < marks[:, None]) | ((keys[None, :] == marks[:, None]) & (numbers[None, :] < at[:, None]))).sum(1)


def _count(kind: pa.DataType):
    """(query_id, number, by_words, by_vector): how many of a task's chunks come before each mark of a question in either ranking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, Asked] = {}
        totals: dict = {}
        for batch in batches:
            for block in opened(batch, cache):
                distances, numbers = block.distances(), block.numbers()
                marked = block.asked.rows.field("marks")
                for q, key in enumerate(block.asked.keys):
                    if not marked[q].is_valid:
                        continue
                    at, own_score, own_distance = (marked[q].values.field(c).fill_null(np.nan).to_numpy(zero_copy_only=False) if c == "distance" else marked[q].values.field(c).to_numpy(zero_copy_only=False) for c in ("number", "score", "distance"))
                    score, _ = block.scores(q)
                    counts = np.stack((_before(-score, numbers, -own_score, at), _before(distances[q], numbers, own_distance, at)))
                    totals[key] = (at, totals[key][1] + counts if key in totals else counts)
        for key, (at, counts) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), kind), pa.array(at), *(pa.array(c.astype(np.int64)) for c in counts)], names=["query_id", "number", "by_words", "by_vector"])
        give_back()

    return run


_LISTED = "base long, places binary, scores binary, distances binary"
#: A chunk or question without a vector, where distances are whole billionths.
_NO_DISTANCE = 2**32 - 1


def _listed(keys: list[str]):
    """Of each question and block a row of the chunks within the question's floors, beside the question's columns `keys`: their places in
    the block (null: all of it), scores, and distances in billionths, which is what they are rounded to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, Asked] = {}
        for batch in batches:
            for block in opened(batch, cache):
                distances, numbers = block.distances(), block.numbers()
                whole = np.where(np.isnan(distances), _NO_DISTANCE, np.round(np.nan_to_num(distances) * 1e9)).astype("<u4")
                low, low_at, far, far_at = _floors(block.asked)
                rows: list[tuple] = []
                for q in range(len(block.asked.keys)):
                    score, _ = block.scores(q)
                    d = distances[q]
                    hit = (score > low[q]) | ((score == low[q]) & (numbers <= low_at[q])) | (d < far[q]) | ((d == far[q]) & (numbers <= far_at[q]))
                    if hit.all():
                        rows.append((q, None, score.tobytes(), whole[q].tobytes()))
                    elif hit.any():
                        rows.append((q, np.flatnonzero(hit).astype("<u2").tobytes(), score[hit].tobytes(), whole[q][hit].tobytes()))
                if rows:
                    at, *binary = zip(*rows, strict=True)
                    columns = [block.asked.rows.field(c).take(pa.array(at)) for c in keys]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([int(numbers[0])] * len(at)), *(pa.array(x, pa.binary()) for x in binary)], names=[*keys, "base", "places", "scores", "distances"])
        give_back()

    return run


def _whole(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, scores, distances) of the chunks in a question's rows."""
    numbers, scores, distances = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
    for base, places, some, far in zip(*(table.column(c) for c in ("base", "places", "scores", "distances")), strict=True):
        scores.append(np.frombuffer(some.as_buffer(), "<f8"))
        numbers.append(base.as_py() + (np.frombuffer(places.as_buffer(), "<u2").astype(np.int64) if places.is_valid else np.arange(len(scores[-1]))))
        d = np.frombuffer(far.as_buffer(), "<u4")
        distances.append(np.where(d == _NO_DISTANCE, np.nan, d / 1e9))
    return np.concatenate(numbers), np.concatenate(scores), np.concatenate(distances)


def _cut(place: int):
    """A question's floors: the chunks at a place of either ranking of the listed ones; open where there are fewer."""

    def run(table: pa.Table) -> pa.Table:
        numbers, scores, distances = _whole(table)
        out = []
        for keys, sign in ((-scores, -1.0), (distances, 1.0)):
            order = np.lexsort((numbers, keys))[: int((~np.isnan(keys)).sum())]
            out += [sign * keys[order[place]], numbers[order[place]]] if place < len(order) else [sign * np.inf, 2**62]
        return pa.table([table.column("query_id").slice(0, 1), *(pa.array([x], t) for x, t in zip(out, (pa.float64(), pa.int64()) * 2, strict=True))], names=["query_id", *_FLOORS])

    return run


def _with_floors(blocks: Blocks, questions: DataFrame, first: int | None = None, depth: int = 0) -> DataFrame:
    """Questions with floors from a sample of blocks: those of the sample's `first` chunks of a ranking, which at least as many of the
    corpus reach, or else of the place that about `depth` chunks of the corpus reach."""
    q_type = questions.schema["query_id"].dataType.simpleString()
    sample = staged(blocks.sample())
    share = sample.agg(F.sum(F.size("chunk_ids"))).first()[0] / max(1, blocks.chunks)
    place = (first or math.ceil(share * depth)) - 1
    listed = meet(sample, questions).mapInArrow(_listed(["query_id"]), f"query_id {q_type}, {_LISTED}")
    floors = listed.groupBy("query_id").applyInArrow(_cut(place), f"query_id {q_type}, floor_score double, floor_number long, floor_distance double, floor_at long")
    return staged(questions.join(floors, "query_id", "left"))


def _narrowed(blocks: Blocks, asked: DataFrame, most: int) -> DataFrame:
    """Questions with the floors of their first `most` places, from samples of the blocks, each WIDER times as large as the one before: so
    a sample, and at last the corpus, has about WIDER * most chunks within the floors of the one before, however large it is."""
    if blocks.blocks <= blocks_of.SAMPLE:
        return asked
    floored, many = _with_floors(blocks, asked, first=most), blocks_of.SAMPLE * WIDER
    while many < blocks.blocks:
        rows = staged(_first_places(blocks.sample(many), blocks, floored, most))
        by_words = rows.filter(F.col("_l") == most).select("query_id", F.col("score").alias("floor_score"), F.col("number").alias("floor_number"))
        by_vector = rows.filter((F.col("_v") == most) & F.col("distance").isNotNull()).select("query_id", F.col("distance").alias("floor_distance"), F.col("number").alias("floor_at"))
        floored = staged(asked.join(by_words, "query_id", "left").join(by_vector, "query_id", "left"))
        many *= WIDER
    return floored


def _first_places(sample: DataFrame, blocks: Blocks, asked: DataFrame, most: int) -> DataFrame:
    """(query_id, chunk_id, number, score, distance, _l, _v): each question's first places in either ranking of some blocks, from 1; places
    beyond `most` are not true ones."""
    kind, q_type = arrow_type(asked, "query_id"), asked.schema["query_id"].dataType.simpleString()
    per = Window.partitionBy("query_id")
    rows = meet(sample, asked).mapInArrow(_candidates(most, kind), f"query_id {q_type}, chunk_id {blocks.chunk_type}, number long, score double, distance double")
    by_words, by_vector = (F.row_number().over(per.orderBy(*o)).cast("long") for o in ((F.desc("score"), "number"), (F.asc_nulls_last("distance"), "number")))
    return rows.withColumns({"_l": by_words, "_v": by_vector}).filter((F.col("_l") <= most) | (F.col("distance").isNotNull() & (F.col("_v") <= most)))


def top_fused(blocks: Blocks, questions: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, number, rrf, distance, bm25_rank, rank from 0) of the k best chunks of each question (query_id, terms, vector).

    Scores and distances are rounded to nine places; ties of either ranking go to the smaller chunk_id, ties of the sum, rounded to twelve
    places, to the better lexical rank.  Chunks without a vector have distance 1 and no vector rank, and so have all chunks of a question
    without one.  Chunks that hold no term score 0.  Where there are many blocks, samples of them give thresholds for the first places.
    """
    kind, q_type = arrow_type(questions, "query_id"), questions.schema["query_id"].dataType.simpleString()
    most = fusion.RRF_K + 2 * k
    per = Window.partitionBy("query_id")
    asked = staged(questions.select("query_id", "terms", "vector"))
    placed = _first_places(blocks.frame, blocks, _narrowed(blocks, asked, most), most)
    # at most 2 * most rows a question
    found = staged(placed.withColumns({"_l": F.when(F.col("_l") <= most, F.col("_l") - 1), "_v": F.when(F.col("distance").isNotNull() & (F.col("_v") <= most), F.col("_v") - 1)}))
    open_ones = found.filter(F.col("_l").isNull() | (F.col("_v").isNull() & F.col("distance").isNotNull()))
    marks = open_ones.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("number", "score", "distance"))).alias("marks"))
    counted = meet(blocks.frame, asked.join(marks, "query_id")).mapInArrow(_count(kind), f"query_id {q_type}, number long, by_words long, by_vector long")
    summed = counted.groupBy("query_id", "number").agg(F.sum("by_words").alias("by_words"), F.sum("by_vector").alias("by_vector"))
    ranked = found.join(summed, ["query_id", "number"], "left")
    ranked = ranked.withColumns({"bm25_rank": F.coalesce("_l", "by_words"), "v_rank": F.when(F.col("distance").isNotNull(), F.coalesce("_v", "by_vector"))})
    ranked = ranked.withColumn("rrf", fusion.rrf_term(F.col("bm25_rank")) + F.coalesce(fusion.rrf_term(F.col("v_rank")), F.lit(0.0)))
    ranked = ranked.withColumn("_n", F.row_number().over(per.orderBy(F.round("rrf", 12).desc(), "bm25_rank"))).filter(F.col("_n") <= k)
    return ranked.select("query_id", "chunk_id", "number", "rrf", F.coalesce("distance", F.lit(1.0)).alias("distance"), "bm25_rank", (F.col("_n") - 1).cast("long").alias("rank"))


def _term(rank: np.ndarray) -> np.ndarray:
    return 1.0 / (fusion.RRF_K + rank)


def _ranks(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Places by (key, number)."""
    out = np.empty(len(keys), np.int64)
    out[np.lexsort((numbers, keys))] = np.arange(len(keys))
    return out


def fused_places(numbers: np.ndarray, scores: np.ndarray, distances: np.ndarray, floors: tuple[float, float, float, float], total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(least and greatest fused place of each listed chunk, least place of any other), from the chunks that lie within the floors of
    either ranking; total: the chunks of the corpus."""
    none = np.isnan(distances)
    if len(numbers) == total:
        by_words = _ranks(-scores, numbers)
        by_vector = np.where(none, 0, _ranks(np.where(none, np.inf, distances), numbers))
        rrf = _term(by_words) + np.where(none, 0.0, _term(by_vector))
        place = _ranks(-np.round(rrf, 12), by_words)
        return place, place, total
    within = []
    for keys, floor, at in ((-scores, -floors[0], floors[1]), (distances, floors[2], floors[3])):
        sure = (keys < floor) | ((keys == floor) & (numbers <= at))
        depth = int(sure.sum())
        rank = np.full(len(keys), depth)
        rank[sure] = _ranks(keys[sure], numbers[sure])
        within.append((sure, rank, depth))
    (words, l_rank, l_depth), (near, v_rank, v_depth) = within
    least = _term(np.where(words, l_rank, total - 1)) + np.where(none, 0.0, _term(np.where(near, v_rank, total - 1)))
    most = _term(l_rank) + np.where(none, 0.0, _term(v_rank))
    # behind an open floor there is nothing left, but for chunks without a vector
    beyond = _term(np.array(l_depth)) + (0.0 if floors[2] == np.inf else _term(np.array(v_depth)))
    room = 2e-12
    low, high = np.sort(least), np.sort(most)
    first = len(low) - np.searchsorted(low, most + room, "right")
    last = len(high) - np.searchsorted(high, least - room, "left") - 1 + np.where(beyond + room < least, 0, total - len(numbers))
    return first, last, int(len(low) - np.searchsorted(low, beyond + room, "right"))


def group_sums(places: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """(numbers, least and greatest sum of each, least place with the first question, greatest sum of any chunk not listed) of a group;
    places: (numbers, least place, greatest place, least place of others) of its questions in order."""
    numbers = np.unique(np.concatenate([p[0] for p in places]))
    low, high, rank = np.zeros(len(numbers)), np.zeros(len(numbers)), np.zeros(len(numbers), np.int64)
    for i, (own, first, last, other) in enumerate(places):
        best, worst = np.full(len(numbers), other), np.full(len(numbers), total - 1)
        at = np.searchsorted(numbers, own)
        best[at], worst[at] = first, last
        low, high = low + _term(worst), high + _term(best)
        if i == 0:
            rank = best
    return numbers, low, high, rank, float(sum(_term(np.array(p[3])) for p in places))


def contenders(places: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], k: int, total: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], float]:
    """The places of the chunks whose sums may be among a group's k greatest, and what the sums of the listed others stay below.

    The k-th of the sums that some chunks reach for sure is a threshold; a chunk that is behind a place in every question stays below it.
    """
    picked = lambda keep: [(p[0][m], p[1][m], p[2][m], p[3]) for p, m in zip(places, keep, strict=True)]
    heads = np.unique(np.concatenate([p[0][firsts(p[2], k)] for p in places]))
    low = np.sort(group_sums(picked([np.isin(p[0], heads) for p in places]), total)[1])
    if len(low) < k:
        return places, 0.0
    behind = math.ceil(len(places) / (float(low[-k]) - 1e-11)) - fusion.RRF_K
    if behind >= min(p[3] for p in places):
        return places, 0.0
    kept = np.unique(np.concatenate([p[0][p[1] <= behind] for p in places]))
    return picked([np.isin(p[0], kept) for p in places]), len(places) / (fusion.RRF_K + behind + 1)


def _fuse_group(k: int, total: int):
    """A group's first k: (group_id, number, rrf, rank, sure)."""

    def run(table: pa.Table) -> pa.Table:
        order = {}
        for i, place in enumerate(table.column("query_ord").to_pylist()):
            order.setdefault(place, []).append(i)
        places = []
        for at in (order[x] for x in sorted(order)):
            rows = table.take(pa.array(at))
            numbers, scores, distances = _whole(rows)
            floors = tuple(rows.column(c)[0].as_py() for c in _FLOORS) if _FLOORS[0] in rows.column_names else (-np.inf, 2**62, np.inf, 2**62)
            first, last, other = fused_places(numbers, scores, distances, floors, total)
            small = np.int32 if total < 1 << 31 else np.int64
            places.append((numbers.astype(small), first.astype(small), last.astype(small), other))
            del rows, numbers, scores, distances, first, last
        known = all(len(p[0]) == total and (p[1] == p[2]).all() for p in places)
        places, others = contenders(places, k, total)
        numbers, low, high, rank, beyond = group_sums(places, total)
        # with all places known, low is high, and ties follow the first question's place
        at = np.lexsort((numbers, rank, -np.round(low, 12)))[:k]
        sure = known
        if not known and len(at):
            rest = np.ones(len(numbers), bool)
            rest[at] = False
            after = max(beyond, others, float(high[rest].max(initial=0.0)))
            next_best = np.append(high[at][1:], after)
            sure = bool((low[at] > next_best + 2e-12).all() and (np.round(low[at], 6) == np.round(high[at], 6)).all())
        group = table.column("group_id").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(at), np.int64)))
        return pa.table([group, pa.array(numbers[at].astype(np.int64)), pa.array(low[at]), pa.array(np.arange(len(at))), pa.array([sure] * len(at), pa.bool_())], names=["group_id", "number", "rrf", "rank", "sure"])

    return run


def top_fused_groups(blocks: Blocks, questions: DataFrame, k: int, depth: int = DEPTH) -> DataFrame:
    """(group_id, chunk_id, number, rrf, distance, rank from 0) of the k best chunks of each group's fused questions.

    questions: (group_id, query_ord, terms, vector), with places of their own in the group; their rankings are those of top_fused().  The distance is that of the group's
    first question (1 without a vector); sums are exact to six places.  Ties of the sum, rounded to twelve places, go to the better place in
    the first question's ranking, then to the smaller chunk_id.  Groups that a depth leaves open are read DEEPER times as deep, on their own.
    What a group's task holds grows with its questions and the depth: about 12 bytes for each question and chunk.
    """
    g_type = questions.schema["group_id"].dataType.simpleString()
    rows = staged(questions.select("group_id", "query_ord", "terms", "vector").withColumn("query_id", F.monotonically_increasing_id()))
    keys, parts = ["group_id", "query_ord", "query_id"], []
    o_type = rows.schema["query_ord"].dataType.simpleString()
    asked = rows
    while True:
        whole = depth >= blocks.chunks
        if not whole:
            asked = _with_floors(blocks, asked, depth=depth)
        own = [*keys, *([] if whole else _FLOORS)]
        shape = f"group_id {g_type}, query_ord {o_type}, query_id long, " + ("" if whole else "floor_score double, floor_number long, floor_distance double, floor_at long, ") + _LISTED
        # what is listed is sent once, to its group
        listed = meet(blocks.frame, asked).mapInArrow(_listed(own), shape)
        fused = staged(listed.groupBy("group_id").applyInArrow(_fuse_group(k, blocks.chunks), f"group_id {g_type}, number long, rrf double, rank long, sure boolean"))
        parts.append(fused.filter("sure"))
        left = fused.filter("NOT sure").select("group_id").distinct()
        if whole or left.isEmpty():
            break
        depth *= DEEPER
        asked = rows.join(left, "group_id", "left_semi")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    # k rows a group meet their chunks and the first question's vector
    names = blocks.frame.select(F.posexplode(F.arrays_zip("chunk_ids", "vectors")).alias("_at", "_c"), "base").select((F.col("base") + F.col("_at")).alias("number"), F.col("_c.chunk_ids").alias("chunk_id"), F.col("_c.vectors").alias("_chunk"))
    first = rows.groupBy("group_id").agg(F.min_by("vector", "query_ord").alias("_question"))
    named = names.join(out.select("group_id", "number", "rrf", "rank"), "number").join(first, "group_id")
    cosine = dot(F.col("_question"), F.col("_chunk")) / F.nullif(norm(F.col("_question")) * norm(F.col("_chunk")), F.lit(0.0))
    both = F.col("_question").isNotNull() & F.col("_chunk").isNotNull()
    fit = both & (F.size("_question") == F.size("_chunk"))
    distance = F.when(fit, F.round(F.coalesce(1 - cosine, F.lit(1.0)), 9)).otherwise(F.lit(1.0))
    return named.select("group_id", "chunk_id", "number", "rrf", distance.alias("distance"), "rank")
