"""Blocks of chunks against rankings of the whole corpus."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesela.operators import blocks, fusion, grid, lexical, topfused, vectors

WORDS = [f"palabra{i}" for i in range(40)]


def corpus(spark, n, seed=8, questions=6):
    """Texts of few words, so that ties are many; every other chunk has a vector, the last question has none, one has no words."""
    rng = random.Random(seed)
    some = lambda most: " ".join(rng.choice(WORDS[: rng.choice((2, 10, 40))]) for _ in range(rng.randrange(most)))
    vec = lambda: [float(rng.randrange(-2, 3)) for _ in range(3)]
    texts = spark.createDataFrame([(f"c{i:04d}", some(12)) for i in range(n)], "chunk_id string, text string").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", some(9) if i else "") for i in range(questions)], "query_id string, question string")
    qv = spark.createDataFrame([(f"q{i}", vec()) for i in range(questions - 1)], "query_id string, vector array<float>")
    cv = spark.createDataFrame([(f"c{i:04d}", vec() if i % 6 else [1.0]) for i in range(0, n, 2)] + [("elsewhere", vec())], "chunk_id string, vector array<float>").repartition(5)
    return texts, asked, qv, cv


def packed(texts, asked, qv, cv, size):
    index = lexical.bm25_index(texts)
    terms = lexical.question_terms(asked, text="question")
    return index, terms, blocks.corpus_blocks(index, cv, size), blocks.weighted_questions(terms, index, qv, asked)


def full(texts, asked, qv, cv, index, terms):
    scores = lexical.bm25_scores(index, terms)
    held = cv.join(texts.select("chunk_id"), "chunk_id", "left_semi")
    return fusion.fuse(scores, vectors.cosine_distances(qv, held), texts, asked)


@pytest.mark.parametrize(("n", "size"), [(400, 7), (400, 2048), (30, 4), (1, 1)])
def test_top_fused_equals_the_full_ranking(spark, n, size):
    tables = corpus(spark, n)
    index, terms, held, asked = packed(*tables, size)
    assert held.chunks == n and held.blocks >= n // size
    want = full(*tables, index, terms).filter("rank < 9")
    shape = lambda df: sorted((r.query_id, r.chunk_id, round(r.rrf, 9), round(r.distance, 6) + 0.0, r.bm25_rank, r["rank"]) for r in df.collect())
    assert shape(topfused.top_fused(held, asked, 9)) == shape(want)


@pytest.mark.parametrize(("n", "size", "depth"), [(300, 9, 12), (300, 2048, 1 << 16), (300, 9, 250), (5, 2, 2)])
def test_groups_equal_the_full_second_fusion(spark, n, size, depth):
    tables = corpus(spark, n, seed=3)
    index, terms, held, asked = packed(*tables, size)
    grouped = asked.withColumns({"group_id": F.substring("query_id", 2, 1).cast("int") % 2, "query_ord": -F.substring("query_id", 2, 1).cast("int")})
    both = full(*tables, index, terms).join(grouped.select("query_id", "group_id", "query_ord"), "query_id")
    want = fusion.fuse_questions(both).filter("rank < 6")
    shape = lambda df: sorted((r.group_id, r["rank"], r.chunk_id, round(r.rrf, 6), round(r.distance, 6) + 0.0) for r in df.collect())
    assert shape(topfused.top_fused_groups(held, grouped, 6, depth)) == shape(want)


@pytest.mark.parametrize("size", [5, 2048])
def test_top_scored_equals_all_scores(spark, size):
    tables = corpus(spark, 300, seed=5)
    index, terms, held, asked = packed(*tables, size)
    rows = sorted((r.query_id, -round(r.score, 9), r.chunk_id) for r in lexical.bm25_scores(index, terms).collect())
    want, place = [], {}
    for q, score, chunk in rows:
        place[q] = place.get(q, -1) + 1
        if place[q] < 4:
            want.append((q, chunk, -score, place[q]))
    got = blocks.top_scored(held, asked, 4)
    assert sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in got.collect()) == sorted(want)


def test_questions_in_lines(spark, monkeypatch):
    """Questions beyond the broadcast bound meet the blocks by shuffles, with the same rows."""
    tables = corpus(spark, 200, questions=9)
    index, terms, held, asked = packed(*tables, 16)
    asked = blocks.staged(asked)
    few = blocks.meet(held.frame, asked)
    monkeypatch.setattr(grid, "BROADCAST", 200)
    monkeypatch.setattr(blocks, "QUESTIONS", 2)
    lines = blocks.meet(held.frame, asked)
    plan = lines._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoopJoin" not in plan
    pairs = lambda df: sorted(df.select("base", F.explode("asked.query_id")).collect())
    assert pairs(lines) == pairs(few) and len(pairs(few)) == held.blocks * 9
    best = lambda: sorted(map(tuple, blocks.top_scored(held, asked, 3).collect()))
    by_lines = best()
    monkeypatch.undo()
    assert by_lines == best()


def test_plans(spark):
    tables = corpus(spark, 100)
    _, _, held, asked = packed(*tables, 16)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(blocks.top_scored(held, asked, 3))
    grouped = asked.withColumns({"group_id": F.lit(1), "query_ord": F.col("query_id")})
    for df in (blocks.top_scored(held, asked, 3), topfused.top_fused(held, asked, 3), topfused.top_fused_groups(held, grouped, 3)):
        assert "Cartesian" not in plan(df)


def test_no_corpus_and_no_questions(spark):
    tables = corpus(spark, 20)
    none = (tables[0].limit(0), tables[1], tables[2], tables[3])
    _, _, held, asked = packed(*none, 4)
    assert topfused.top_fused(held, asked, 3).count() == blocks.top_scored(held, asked, 3).count() == 0
    _, _, held, asked = packed(tables[0], tables[1].limit(0), tables[2].limit(0), tables[3], 4)
    assert topfused.top_fused(held, asked, 3).count() == blocks.top_scored(held, asked, 3).count() == 0
    grouped = asked.withColumns({"group_id": F.lit(1), "query_ord": F.col("query_id")})
    assert topfused.top_fused_groups(held, grouped, 3).count() == 0


def test_a_depth_bounds_every_place():
    """Places from a part of both rankings hold the true ones between them."""
    rng = np.random.default_rng(4)
    n = 500
    scores, distances = np.round(rng.gamma(1, 1, n), 1), np.where(rng.random(n) < 0.2, np.nan, np.round(rng.random(n), 2))
    numbers = np.arange(n)
    place, _, _ = topfused.fused_places(numbers, scores, distances, (0, 0, 0, 0), n)
    order = np.lexsort((numbers, -scores))[40], np.lexsort((numbers, distances))[25]
    floors = (scores[order[0]], order[0], distances[order[1]], order[1])
    listed = (scores > floors[0]) | ((scores == floors[0]) & (numbers <= floors[1])) | (distances < floors[2]) | ((distances == floors[2]) & (numbers <= floors[3]))
    first, last, other = topfused.fused_places(numbers[listed], scores[listed], distances[listed], floors, n)
    assert (first <= place[listed]).all() and (place[listed] <= last).all() and place[~listed].min() >= other
    assert (first == last).sum() >= 1 and listed.sum() < 80


def test_blocks_are_left_out_by_their_bounds(monkeypatch):
    """Of ten blocks, those whose bounds the best chunk beats aren't scored."""
    scored = []
    real = blocks.Block.scores
    monkeypatch.setattr(blocks.Block, "scores", lambda self, q: (scored.append(self.i), real(self, q))[1])
    entry = pa.struct([("term", pa.string()), ("gain", pa.float64())])
    question = pa.array([{"query_id": 1, "terms": [{"term": "x", "gain": 2.0}], "vector": None}], pa.struct([("query_id", pa.int64()), ("terms", pa.list_(entry)), ("vector", pa.list_(pa.float64()))]))
    gains = [0.1 * i for i in (3, 9, 1, 2, 5, 4, 8, 6, 7, 10)]
    one = lambda x, t: pa.array([np.array([x], t).tobytes()] * 10, pa.binary())
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(10), pa.int64()), pa.array([[f"c{i}"] for i in range(10)]), pa.array([["x"]] * 10), *(pa.array([np.array([x]).tobytes() for x in values], pa.binary()) for values in (gains, [(lexical.K1 + 1) / g - 1 for g in gains])), one(1, "<i4"),
         pa.array([np.array([0, 1], "<i4").tobytes()] * 10, pa.binary()), one(0, "<u2"), pa.array([0] * 10), pa.array([question.to_pylist()] * 10, pa.list_(question.type))],
        names=["base", "chunk_ids", "terms", "tops", "norms", "tfs", "starts", "places", "q_block", "asked"],
    )
    (found,) = blocks._scored(2, pa.int64())(iter([batch]))
    assert found.column("chunk_id").to_pylist() == ["c9", "c1"] and scored == [9, 1]


def test_nearest_limits_groups_and_meets_by_lines(spark, monkeypatch):
    rng = random.Random(1)
    vec = lambda: [float(rng.randrange(-2, 3)) for _ in range(3)]
    q = blocks.staged(spark.createDataFrame([(i, vec()) for i in range(30)], "query_id long, vector array<double>"))
    c = blocks.staged(spark.createDataFrame([(i, vec()) for i in range(300)], "chunk_id long, vector array<double>"))
    got = vectors.nearest(q, c, 5)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(grid, "BROADCAST", 300)
    lines = vectors.nearest(q, c, 5)
    assert "NestedLoop" not in lines._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, lines.collect())) == rows and len(rows) == 150


def test_terms_are_counted_in_slices(monkeypatch):
    rows = pa.array([["b", "a", "b"], [], None, ["a"], ["c"] * 9, ["a", "c"]], pa.list_(pa.string()))
    whole = lexical._counted(rows).to_pylist()
    assert whole[0] == [{"term": "a", "tf": 1}, {"term": "b", "tf": 2}] or whole[0] == [{"term": "b", "tf": 2}, {"term": "a", "tf": 1}]
    monkeypatch.setattr(lexical, "TOKENS", 4)
    by_term = lambda x: [sorted((e["term"], e["tf"]) for e in row or []) for row in x]
    assert by_term(lexical._counted(rows).to_pylist()) == by_term(whole) == [[("a", 1), ("b", 2)], [], [], [("a", 1)], [("c", 9)], [("a", 1), ("c", 1)]]
    assert lexical._counted(rows.slice(0, 0)).to_pylist() == []


def test_counting_yields_slices(monkeypatch):
    """A batch is counted in slices that are sent on, so a worker never holds the counts of all of it."""
    monkeypatch.setattr(lexical, "TOKENS", 4)
    rows = pa.array([["b", "a", "b"], [], None, ["a"], ["c"] * 9, ["a", "c"]], pa.list_(pa.string()))
    parts = list(lexical._counted_rows(iter([pa.RecordBatch.from_arrays([pa.array(range(6)), rows], names=["chunk_id", "tokens"])])))
    assert len(parts) > 2
    told = [r for p in parts for r in p.to_pylist()]
    assert [(r["chunk_id"], r["dl"]) for r in told] == [(0, 3), (1, 0), (2, 0), (3, 1), (4, 9), (5, 2)]
    assert sorted((e["term"], e["tf"]) for e in told[0]["counts"]) == [("a", 1), ("b", 2)]


def test_opened_questions_dont_keep_their_batch(spark):
    """A worker keeps the questions it has opened, but not the blocks that came with them."""
    index, terms, held, asked = packed(*corpus(spark, 60), 8)
    table = blocks.meet(held.frame, asked).toArrow().combine_chunks()
    batch, cache = table.to_batches()[0], {}
    list(blocks.opened(batch, cache))
    there = [b for b in batch.column("asked").values.field("query_id").buffers() if b is not None]
    assert cache and all({b.address for b in there}.isdisjoint({b.address for b in a.ids.buffers() if b is not None}) for a in cache.values())


def test_nearest_takes_few_questions_at_once(spark, monkeypatch):
    seen = []
    real = vectors.unit_distances
    monkeypatch.setattr(vectors, "unit_distances", lambda c, q: seen.append(len(q)) or real(c, q))
    v = pa.array([[float(i % 7), float(i % 5)] for i in range(150)], pa.list_(pa.float64()))
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    ids = pa.array(range(150))
    batch = pa.RecordBatch.from_arrays([one(ids), one(v), one(ids), one(v)], names=["chunk_ids", "chunk_vectors", "ids", "vectors"])
    got = pa.Table.from_batches(vectors._nearest(3)(iter([batch])))
    assert max(seen) <= 64 and got.num_rows == 450
    d = real(vectors.unit_rows(v, 2), vectors.unit_rows(v, 2))
    assert got.column("distance").to_pylist() == [x for row in d for x in sorted(row)[:3]] or sorted(got.column("distance").to_pylist()) == sorted(x for row in d for x in sorted(row)[:3])


@pytest.mark.parametrize("total", [900, 5000])
def test_contenders_are_few_and_hold_the_first(total):
    rng = np.random.default_rng(total)
    places = []
    for _ in range(3):
        own = rng.permutation(total)[: min(total, 4000)]
        first = rng.permutation(total)[: len(own)] if len(own) == total else np.sort(rng.permutation(4000))[rng.permutation(len(own))]
        last = first if len(own) == total else first + rng.integers(0, 3, len(own))
        places.append((own, first, last, total if len(own) == total else 4000))
    some, others = topfused.contenders(places, 5, total)
    full, few = topfused.group_sums(places, total), topfused.group_sums(some, total)
    assert len(few[0]) < len(full[0]) / 2 and others < np.sort(full[1])[-5]
    best = lambda s: [(int(s[0][i]), round(float(s[1][i]), 12), round(float(s[2][i]), 12)) for i in np.lexsort((s[0], s[3], -np.round(s[1], 12)))[:5]]
    assert best(few) == best(full)
    left = ~np.isin(full[0], few[0])
    assert full[2][left].max() <= max(others, 0.0) + 1e-15
