import json
import time

import pytest
from pyspark.sql import functions as F

from tesela.functions import models, structured
from tesela.plans import assistant, retrieval
from tesela.settings import Settings
from tesela.sources import files, snapshots
from tesela.streaming import watch


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"label": "{nope}"}', {"label": "{nope}"}),
        ("[1,2,]", [1, 2]),
        ('Aqui va: [{"a": 1}, {"a": 2}] y fin', [{"a": 1}, {"a": 2}]),
        ('{"a": 1', None),
        ('texto {"a": "\\"}"} [1]', {"a": '"}'}),
        ("[roto {\"a\": 1}", {"a": 1}),
        ("", None),
        (None, None),
    ],
)
def test_tolerant_json(raw, want):
    assert structured.tolerant_json(raw) == want


def labels(spark, raw):
    df = spark.createDataFrame([(raw,)], "x string")
    items = df.select(structured.label_items(F.col("x")).alias("items"))
    return [(r.label, r.weight) for r in items.select(structured.normalized_weights(F.col("items")).alias("l")).first().l]


def test_labels(spark):
    c, m = "riesgo_credito", "riesgo_mercado"
    assert labels(spark, json.dumps([{"label": c, "weight": 0}, {"label": " RIESGO_CREDITO ", "weight": 0.4}])) == [(c, 0.4)]
    assert labels(spark, json.dumps([{"label": c, "weight": 1.5}, {"label": m, "weight": 0.5}])) == [(c, 0.6667), (m, 0.3333)]
    assert labels(spark, json.dumps(["x", 42, {"label": m, "weight": "0.5"}, {"label": "otro", "weight": 1}, {"label": c, "weight": "mal"}])) == [(m, 0.5)]
    assert labels(spark, json.dumps({"result": [{"label": c, "weight": 0.3}]})) == [(c, 0.3)]
    assert labels(spark, '{"result":[1,2,3]}') == labels(spark, "text") == labels(spark, "42") == []


def test_labels_of_long_lists_take_time_in_proportion(spark):
    """4,000 items a row, in 400 rows, took minutes while each item went through the list."""
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda i: F.struct(F.when(i % 2 == 0, "riesgo_credito").otherwise("Riesgo_Mercado ").alias("label"), F.lit(0.8).alias("weight"))).alias("items"))
    many = rows.select(F.explode(F.sequence(F.lit(1), F.lit(400))).alias("n"), "items").repartition(4)
    began = time.perf_counter()
    got = many.select(structured.normalized_weights(F.col("items")).alias("l")).distinct().collect()
    assert [[(x.label, x.weight) for x in r.l] for r in got] == [[("riesgo_credito", 0.5), ("riesgo_mercado", 0.5)]]
    assert time.perf_counter() - began < 60


def test_fields(spark):
    raw = json.dumps({"decisiones_comite": [{"accion": "aprobo", "detalle": "el limite"}, "Aprobo", "APROBO", "", 2025.5], "fechas_criticas": "no"})
    df = spark.createDataFrame([(raw,)], "x string")
    got = df.select(structured.field_items(F.col("x"), structured.EXTRACT_CATEGORIES, True).alias("m")).first().m
    assert got == {"limites_regulatorios": [], "indicadores_riesgo": [], "decisiones_comite": ["aprobo - el limite", "Aprobo", "2025.5"], "fechas_criticas": []}
    raw = json.dumps({"decisiones": [{"a": "b"}]})
    got = spark.createDataFrame([(raw,)], "x string").select(structured.field_items(F.col("x"), structured.SUMMARY_FIELDS, False).alias("m")).first().m
    assert got["decisiones"] == ["{'a': 'b'}"]


def broken_reduce(system, user, temperature, most):
    """Answers chunks with their first word and fails on reductions."""
    if "Parciales" in user:
        return "no puedo"
    return json.dumps({"decisiones": [user.split("Fragmento:\n")[1].split()[0]]})


def test_map_reduce_falls_back_to_the_merge(spark):
    chunks = spark.createDataFrame([("acta.txt", 1, 0, "Aprobo x"), ("acta.txt", 1, 1, "APROBO y"), ("acta.txt", 2, 0, "Nego z")], "source string, page int, chunk_index int, text string")
    out = {r.field: r["items"] for r in assistant.summarize(chunks, "cot", broken_reduce).collect()}
    assert out == {"decisiones": ["Aprobo", "Nego"], "riesgos_identificados": [], "acciones_pendientes": []}
    with pytest.raises(ValueError):
        assistant.summarize(chunks, "otra", broken_reduce)
    md = assistant.items_markdown(assistant.summarize(chunks, "cot", broken_reduce), structured.SUMMARY_FIELDS).first().markdown
    assert "- Aprobo\n- Nego" in md and "_(sin items)_" in md


def test_embedding_once_per_text(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",), ("y",), ("z",)], "t string")
    assert models.embed_distinct(df, "t", "m").count() == 5
    s = models.cache_stats(df, "t").first()
    assert (s.hits, s.misses, s.size, s.hit_rate) == (2, 3, 3, 0.4)
    assert models.cache_stats(df.limit(0), "t").first().hit_rate == 0.0


def divide(system, user, temperature, most):
    return 'Claro: ["¿Que es el VaR?", "una frase", "¿Cual es el limite?"]'


def test_index_and_ask(spark, tmp_path):
    folder = tmp_path / "docs"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text("ARTICULO 1 Limites\nEl limite de exposicion es 28% del capital.\r\n" * 3, encoding="utf-8")
    (folder / "Acta_b.MD").write_bytes("El VaR se calcula con simulación histórica.".encode("latin-1"))
    (folder / "c.exe").write_text("no")
    (folder / "sub" / "d.txt").write_text("no")
    found = files.corpus_files(spark, str(folder))
    assert sorted(r.source for r in found.collect()) == ["Acta_b.MD", "a.txt"]
    settings = Settings(top_k=2)
    collection = retrieval.index_files(found, settings)
    store = snapshots.SnapshotStore(spark, str(tmp_path / "collection"))
    store.write(collection)
    collection = store.read()
    assert any("simulación" in r.text for r in collection.collect())
    asked = spark.createDataFrame([("q1", "¿Que es el VaR y cual es el limite?"), ("q2", "limite de exposicion")], "query_id string, question string")
    hits = retrieval.retrieve(collection, asked, settings, completer=divide)
    assert {(r.group_id, r.place) for r in hits.collect()} == {("q1", 0), ("q1", 1), ("q2", 0), ("q2", 1)}
    assert {r.rrf for r in hits.filter("group_id = 'q2' AND place = 0").collect()} <= {0.033333, 0.033060, 0.03306}
    answers = {r.query_id: r for r in retrieval.answer(asked, hits.filter("group_id = 'q2'"), models.echo_completer).collect()}
    assert answers["q1"].answer == retrieval.NOT_FOUND
    assert {s.source for s in answers["q2"].sources} == {"a.txt", "Acta_b.MD"}
    reranked = retrieval.retrieve(collection, asked, Settings(top_k=1, reranker_enabled=True), completer=divide)
    assert reranked.filter("blended_score IS NOT NULL").count() == 2
    whole = files.document_chunks(collection.limit(0).select("source", "page", "chunk_index", "text"), found, "a.txt").collect()
    assert len(whole) == 1 and whole[0].text.endswith("\n")


def parse(content):
    if content == b"bad":
        raise ValueError
    return [("corto", [], "texto escaneado mucho mas largo que el nativo"), ("x", ["| t |"], "ocr que no cuenta porque hay una tabla en la pagina"), ("", [], "")]


def test_pdf_pages(spark):
    df = spark.createDataFrame([("a.pdf", "pdf", bytearray(b"ok"), "h"), ("b.pdf", "pdf", bytearray(b"bad"), "h")], files.FILES)
    got = [(r.page, r.text, r.extraction) for r in files.pdf_pages(df, parse).orderBy("page").collect()]
    assert got == [(1, "texto escaneado mucho mas largo que el nativo", "ocr"), (2, "x\n\n| t |", "native")]
    parsed = files.parsed_files(df, parse)
    assert [(r.source, r.error) for r in files.failed_files(parsed).collect()] == [("b.pdf", "ValueError: ")]
    assert files.failed_files(files.parsed_files(df.filter("source = 'a.pdf'"), parse)).count() == 0


def test_steps_of_reasoning_differ_by_task(spark):
    from tesela.plans.prompts import task_prompt

    told = {}
    for task in ("classify", "extract", "summarize", "extract_reduce"):
        for technique in ("zero_shot", "cot"):
            told[task, technique] = spark.range(1).select(task_prompt(task, technique, F.lit("x"))[0]).first()[0]
    steps = [told[t, "cot"].removeprefix(told[t, "zero_shot"]) for t in ("classify", "extract", "summarize")]
    assert len(set(steps)) == 3 and all("PASO 1:" in x and "PASO 4: el JSON" in x for x in steps)
    assert told["extract_reduce", "cot"] == told["extract_reduce", "zero_shot"]
    with pytest.raises(ValueError, match="technique"):
        task_prompt("classify", "other", F.lit("x"))


def test_of_new_rows_with_one_key_the_greatest_stays(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "chunk_id int, text string, page int")
    new = spark.createDataFrame([(2, "x", 1), (2, "x", 9), (2, "c", 99), (3, None, 1)], "chunk_id int, text string, page int").repartition(3)
    assert sorted(tuple(r) for r in snapshots.upsert(old, new).collect()) == [(1, "a", 5), (2, "x", 9), (3, None, 1)]


def test_watching_runs_sync(spark, tmp_path):
    (tmp_path / "in").mkdir()
    runs = []
    (tmp_path / "in" / "a.txt").write_text("x")
    q = watch.watch_folder(spark, str(tmp_path / "in"), lambda: runs.append(1), str(tmp_path / "cp"), "1 seconds")
    q.processAllAvailable()
    q.stop()
    assert len(runs) == 2
