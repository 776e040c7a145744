import datetime as dt

import pytest
from pyspark.sql import functions as F

from tesela.operators import evaluation, fusion, lexical, querylog, sync, vectors
from tesela.operators.chunks import outside_boxes
from tesela.settings import Settings
from tesela.sources import snapshots


def test_settings():
    s = Settings.from_env({"TOP_K": "7", "RERANKER_ENABLED": "Yes", "LLM_MODEL": "x", "RERANKER_ALPHA": "0.25"})
    assert (s.top_k, s.reranker_enabled, s.llm_model, s.reranker_alpha, s.chunk_size) == (7, True, "x", 0.25, 900)
    assert (s.k(0), s.k(None), s.k(3)) == (7, 7, 3)
    assert not Settings.from_env({"RERANKER_ENABLED": "on"}).reranker_enabled


def test_bm25_against_the_formula(spark):
    import math

    texts = {1: "riesgo riesgo mercado", 2: "riesgo credito", 3: "credito liquidez banco", 4: "", 5: "riesgo"}
    docs = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    index = lexical.bm25_index(docs)
    asked = lexical.question_terms(spark.createDataFrame([(9, "riesgo credito credito nada")], "query_id long, text string"))
    got = {r.chunk_id: r.score for r in lexical.bm25_scores(index, asked).collect()}
    toks = {k: v.split() for k, v in texts.items()}
    n, avgdl = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {t: sum(t in d for d in toks.values()) for d in toks.values() for t in d}
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in raw.items()}
    assert raw["riesgo"] < 0
    for k, d in toks.items():
        want = sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for t in ["riesgo", "credito", "credito", "nada"])
        assert got.get(k, 0) == pytest.approx(want)


def test_nearest_and_zero_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    c = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [0.0, 0.0]), (13, [2.0, 0.0])], "chunk_id long, vector array<float>")
    got = [(r.chunk_id, round(r.distance, 9), r["rank"]) for r in vectors.nearest(q, c, 4).orderBy("rank").collect()]
    assert got == [(10, 0.0, 0), (13, 0.0, 1), (11, 1.0, 2), (12, 1.0, 3)]


def test_fusion_ranks_are_zero_based(spark):
    ids = spark.createDataFrame([(i,) for i in range(3)], "chunk_id long")
    qs = spark.createDataFrame([(1,)], "query_id long")
    bm = spark.createDataFrame([(1, 0, 5.0)], "query_id long, chunk_id long, score double")
    dist = spark.createDataFrame([(1, 0, 0.1), (1, 2, 0.2)], "query_id long, chunk_id long, distance double")
    got = {r.chunk_id: (round(r.rrf, 6), r.distance, r["rank"]) for r in fusion.fuse(bm, dist, ids, qs).collect()}
    assert got == {0: (0.033333, 0.1, 0), 1: (round(1 / 61, 6), 1.0, 2), 2: (round(1 / 62 + 1 / 61, 6), 0.2, 1)}


@pytest.mark.parametrize(("alpha", "want"), [(0.0, [1, 2]), (1.7, [3, 2]), (0.5, [2, 1])])
def test_blend(spark, alpha, want):
    hits = spark.createDataFrame([(1, 1, 0.9, 0.1, 0), (1, 2, 0.8, 0.8, 1), (1, 3, 0.1, 0.9, 2)], "query_id long, chunk_id long, rrf double, rerank_score double, rank int")
    assert [r.chunk_id for r in fusion.blend(hits, alpha, 2).orderBy("place").collect()] == want


def test_small_pool_stays_as_it_is(spark):
    hits = spark.createDataFrame([(1, 1, 0.1, 0.1, 0), (1, 2, 0.8, 0.8, 1)], "query_id long, chunk_id long, rrf double, rerank_score double, rank int")
    assert [(r.chunk_id, r.rerank_score, r.blended_score) for r in fusion.blend(hits, 0.5, 2).orderBy("place").collect()] == [(1, None, None), (2, None, None)]


def test_minmax(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 4.0), ("c", 7.0)], "g string, v double")
    got = df.select("g", fusion.minmax(F.col("v"), Window.partitionBy("g")).alias("m")).collect()
    assert sorted((r.g, r.m) for r in got) == [("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 0.5), ("b", 0.5), ("c", 0.5)]


def test_scores(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), (["a"], [])], "expected array<string>, predicted array<string>")
    scored = evaluation.case_scores(df).orderBy(F.size("expected"))
    assert [(r.precision, r.recall, r.f1) for r in scored.collect()] == [(0.0, 0.0, 0.0), (0.5, 0.5, 0.5)]
    m = evaluation.micro_scores(scored).first()
    assert (m.tp, m.fp, m.fn, m.precision, m.recall, m.f1) == (1, 1, 2, 0.5, 0.333, 0.4)
    cov = spark.createDataFrame([(["Límite 28"], ["limite", "zz"]), ([], [])], "i array<string>, k array<string>").select(evaluation.keyword_coverage(F.col("i"), F.col("k")).alias("c"))
    assert [r.c for r in cov.collect()] == [0.5, 1.0]


def test_report_percentiles_by_group(spark):
    rows = [("a", i) for i in range(12)] + [("b", 7), (None, 3), (None, 5), ("b", None)]
    cases = spark.createDataFrame(rows, "g string, latency_ms long").selectExpr("*", "1.0D AS recall", "1.0D AS accuracy", "0.5D AS faithfulness", "0 AS n_warnings")
    got = {r.g: (r.n, r.p50_ms, r.p95_ms) for r in evaluation.evaluation_report(cases, "g").collect()}
    assert got == {"a": (12, 5, 10), "b": (2, 7, 7), None: (2, 4, 3)}
    assert evaluation.evaluation_report(cases.filter("g = 'a'")).first().p95_ms == 10


def test_passage_holders(spark):
    texts = spark.createDataFrame([(1, "uno dos tres cuatro"), (2, "xuno dos tresx"), (3, "dos tres uno"), (4, None), (5, "a.b")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "uno dos tres"), (2, "dos tres"), (3, ""), (4, None), (5, "uno nada tres"), (6, ".")], "query_id long, question string")
    got = {(r.query_id, r.chunk_id) for r in evaluation.passage_holders(texts, asked).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (3, 5), (6, 5)}


def test_passage_holders_by_an_index(spark):
    """Candidates come from term counts that are there already; what a capital sigma becomes hangs on letters outside the passage."""
    texts = spark.createDataFrame([(1, "casa \u039f\u0394\u039f\u03a3'\u0391 roja verde azul"), (2, "casa roja verde gris")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "a \u039f\u0394\u039f\u03a3'"), (2, "sa \u039f\u0394\u039f\u03a3'\u0391 roja ver"), (3, "roja verde g"), (4, "x ausente y")], "query_id long, question string")
    got = {(r.query_id, r.chunk_id) for r in evaluation.passage_holders(texts, asked, lexical.bm25_index(texts)).collect()}
    assert got == {(1, 1), (2, 1), (3, 2)}


def test_purge_boundary_and_bursts(spark):
    now = dt.datetime(2026, 1, 31)
    log = spark.createDataFrame([(1, now - dt.timedelta(days=30)), (2, now - dt.timedelta(days=30, minutes=1))], "id long, ts timestamp")
    assert [r.id for r in querylog.purge(log, F.lit(now), 30).collect()] == [1]
    t = dt.datetime(2026, 1, 1)
    ev = spark.createDataFrame([("a", t), ("a", t + dt.timedelta(seconds=2)), ("b", t), ("b", t + dt.timedelta(seconds=2, milliseconds=1))], "k string, ts timestamp")
    assert sorted((r.k, r.n) for r in querylog.bursts(ev, ["k"], 2).collect()) == [("a", 2), ("b", 1), ("b", 1)]


def test_upsert_twice_and_migration(spark):
    old = spark.createDataFrame([("a", "x", True)], "chunk_id string, text string, is_table boolean")
    new = spark.createDataFrame([("a", "y"), ("b", "z")], "chunk_id string, text string")
    once = snapshots.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", "y", False), ("b", "z", False)]
    assert sorted(map(tuple, snapshots.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))
    legacy = snapshots.with_warnings_column(spark.createDataFrame([(1,)], "id long"))
    assert legacy.first().warnings == []


def test_sync(spark, tmp_path):
    state = sync.sync_state(spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], sync.MANIFEST), spark.createDataFrame([("a", "h1"), ("b", "hX"), ("d", "h4")], sync.MANIFEST))
    assert {r.source: r.status for r in state.collect()} == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "new"}
    assert sync.has_changes(state)
    schema = "chunk_id string, source string, text string"
    collection, manifest = (snapshots.SnapshotStore(spark, str(tmp_path / x)) for x in ("c", "m"))
    index = lambda f: f.filter(F.col("text") != "").select(F.concat("source", F.lit("::p1::c0")).alias("chunk_id"), "source", "text")
    files = lambda rows: spark.createDataFrame(rows, "source string, sha256 string, text string")
    first = sync.sync(collection, manifest, files([("a", "1", "x"), ("b", "2", "y"), ("e", "3", "")]), index, schema)
    assert first == {"unchanged": 0, "new": 3, "modified": 0, "deleted": 0, "indexed_chunks": 2}
    again = sync.sync(collection, manifest, files([("a", "1", "x"), ("b", "5", "w")]), index, schema)
    assert again == {"unchanged": 1, "new": 0, "modified": 1, "deleted": 0, "indexed_chunks": 1}
    assert sorted((r.source, r.text) for r in collection.read().collect()) == [("a", "x"), ("b", "w")]
    assert sync.sync(collection, manifest, files([("a", "1", "x"), ("b", "5", "w")]), index, schema)["unchanged"] == 2


def test_boxes(spark):
    cols = "p int, x0 double, top double, x1 double, bottom double"
    objects = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0), (1, 0.0, 1.0, 2.0, 2.0), (2, 1.0, 1.0, 2.0, 2.0)], cols)
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0)], cols)
    assert sorted((r.p, r.x0) for r in outside_boxes(objects, boxes, ["p"]).collect()) == [(1, 0.0), (2, 1.0)]
