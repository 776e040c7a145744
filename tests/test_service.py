import json

from tesela.operators import evaluation
from tesela.plans.service import Service
from tesela.settings import Settings
from tesela.sources import cases


def test_index_sync_ask(spark, tmp_path):
    corpus = tmp_path / "docs"
    corpus.mkdir()
    (corpus / "a.txt").write_text("El limite de exposicion es 28% del capital.")
    (corpus / "vacio.txt").write_text("  ")
    s = Service(spark, str(tmp_path / "store"), str(corpus), Settings(top_k=2))
    assert {k: v for k, v in s.index().items() if k != "elapsed_s"} == {"pages": 1, "chunks": 1}
    (corpus / "b.md").write_text("El VaR historico usa 500 dias.")
    assert {r.source: r.status for r in s.state().collect()} == {"a.txt": "unchanged", "b.md": "new", "vacio.txt": "new"}
    assert s.sync() == {"unchanged": 1, "new": 2, "modified": 0, "deleted": 0, "indexed_chunks": 1}
    assert s.sync()["new"] == 1  # a file without text stays new
    asked = spark.createDataFrame([("q", "limite de exposicion")], "query_id string, question string")
    row = s.ask(asked).first()
    assert {x.source for x in row.sources} == {"a.txt", "b.md"}
    s.ask(asked)
    log = s.log.read().orderBy("id").collect()
    assert [r.id for r in log] == [1, 2] and log[0].question == "limite de exposicion"


def test_evaluate_and_compare(spark, tmp_path):
    corpus = tmp_path / "docs"
    corpus.mkdir()
    for name, body in (("limite.txt", "El limite de exposicion es 28% del capital."), ("var.md", "El VaR historico usa 500 dias."), ("acta.txt", "El comite aprobo el aumento de capital.")):
        (corpus / name).write_text(body)
    s = Service(spark, str(tmp_path / "store"), str(corpus), Settings(top_k=1, reranker_pool_size=3))
    s.index()
    lines = [
        {"id": "a", "level": "1", "question": "limite de exposicion", "expected_sources": ["limite.txt"], "must_contain": ["28%", "Límite", "ausente"]},
        {"id": "b", "level": "2", "question": "VaR historico dias", "expected_sources": ["otro.txt"]},
        {"id": "c", "level": "2", "question": "comite", "must_contain": ["aprobó"]},
    ]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, lines)))
    questions = cases.load_questions(spark, str(tmp_path / "q.jsonl"))
    scored = s.evaluate(questions)
    got = {r.id: (r.recall, r.accuracy and round(r.accuracy, 3), r.faithfulness, r.missing_in_answer, r.sources) for r in scored.collect()}
    assert got == {"a": (1.0, 0.667, 1.0, ["ausente"], ["limite.txt"]), "b": (0.0, None, None, [], ["var.md"]), "c": (None, 1.0, 1.0, [], ["acta.txt"])}
    report = evaluation.evaluation_report(scored).first()
    assert (report.n, round(report.recall_rate, 3), report.faithfulness) == (3, 0.333, 1.0) and report.p50_ms == report.p95_ms
    assert s.log.read().count() == 0

    def silent(system, user, temperature=0.1, most=1024):
        return ""

    table = {(r.model, r.alpha): (r.n, round(r.recall_rate, 3), round(r.accuracy, 3)) for r in s.compare(questions, {"eco": s.completer, "mudo": silent}, (0.0, 1.0)).collect()}
    assert table == {("eco", 0.0): (3, 0.333, 0.833), ("eco", 1.0): (3, 0.333, 0.833), ("mudo", 0.0): (3, 0.333, 0.0), ("mudo", 1.0): (3, 0.333, 0.0)}


def test_cases(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "q1", "question": "x", "expected_sources": ["a"], "must_contain": []}\n\n')
    assert [r.expected_sources for r in cases.load_questions(spark, str(tmp_path / "q.jsonl")).collect()] == [["a"]]
    doc = {"classification": [{"id": "c", "text": "t", "expected": ["riesgo_credito"]}], "extraction": [{"id": "e", "doc": "d", "expected_keywords": {"f": ["k"]}}], "summary": []}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    assert cases.load_assistant_cases(spark, str(tmp_path / "a.json"), "classification").first().expected == ["riesgo_credito"]
    assert cases.expected_keywords(cases.load_assistant_cases(spark, str(tmp_path / "a.json"), "extraction")).first().keywords == ["k"]
    assert cases.load_assistant_cases(spark, str(tmp_path / "a.json"), "summary").count() == 0
    scored = evaluation.case_scores(spark.createDataFrame([(["a"], ["a"])], "expected array<string>, predicted array<string>"))
    cases.write_report(evaluation.micro_scores(scored), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().f1 == 1.0
