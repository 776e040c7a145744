import pytest
from pyspark.sql import functions as F

from tesela.functions import chunking, text
from tesela.operators import chunks, verify


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [("\0a \t b\n\n\n\nc ", "a b\n\nc"), ("  x  ", "x"), ("", ""), (None, None)])
def test_clean(spark, raw, want):
    assert one(spark, raw, text.clean) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("GARCH 1,1", ["garch"]), ("¿Qué límite?", ["límite"]), ("σ²_t x½", ["σ²_t", "x½"]), ("el la de que para", []), ("", [])],
)
def test_tokens(spark, raw, want):
    assert one(spark, raw, text.tokens) == want


def test_norms(spark):
    assert one(spark, "  METÁFORA  Á", text.normalized) == " metafora a"
    assert one(spark, "ÑANDÚ  é", text.fold) == "nandu  e"


def test_table_markdown(spark):
    kind = "array<array<string>>"
    assert one(spark, [["a", "b", "c"], ["1"]], text.table_markdown, kind) == "| a | b | c |\n| --- | --- | --- |\n| 1 |  |  |\n"
    assert one(spark, [[" x|y\nz ", None], ["1", "2", "3"]], text.table_markdown, kind) == "| x\\|y z |  |\n| --- | --- |\n| 1 | 2 |\n"
    assert one(spark, [], text.table_markdown, kind) == ""
    assert one(spark, [[]], text.table_markdown, kind) == ""


def test_split_tables():
    page = "Intro\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\nCierre"
    assert chunking.split_tables(page) == [("Intro", False), ("| a | b |\n| --- | --- |\n| 1 | 2 |", True), ("Cierre", False)]
    assert chunking.split_tables("| one | line |") == [("| one | line |", False)]
    assert chunking.split_tables("| a |\n| b |") == [("| a |\n| b |", True)]


def test_recursive_split_keeps_its_promises():
    import random

    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12))) for _ in range(n))
    for body in ["\n\n".join(words(rng.randrange(1, 200)) + "." for _ in range(12)), words(900), "x" * 5000, "", "  \n ", "corto"]:
        made = chunking.recursive_split(body, 900, 150)
        assert all(0 < len(c) <= 900 for c in made)
        at = 0
        for c in made:
            place = body.find(c, max(0, at - 150))
            assert place >= 0
            assert not body[at:place].strip()
            at = place + len(c)
        assert not body[at:].strip()


def test_section_hints(spark):
    pages = [
        ("a", 1, "ARTÍCULO 1 Objeto\n" + "palabra " * 30, "text"),
        ("a", 2, "una a b c " * 12 + "\nCAPITULO II Limites\nfin", "text"),
        ("a", 3, "a b", "text"),
        ("b", 1, "nada por aqui 1", "text"),
    ]
    out = chunks.chunk_pages(spark.createDataFrame(pages, "source string, page int, text string, extraction string")).orderBy("source", "page").collect()
    hints = {(r.source, r.page): r.section_hint for r in out}
    assert hints["a", 1] == "ARTÍCULO 1 Objeto"
    assert hints["a", 3] == "CAPITULO II Limites"
    assert [r.chunk_id for r in out][0] == "a::p1::c0"
    assert {r.chunk_index for r in out} == {0}


@pytest.mark.parametrize(
    ("question", "want"),
    [("¿Cual es el limite y el horario?", False), ("¿Que es X y cual es Y?", True), ("¿Primero? ¿Segundo?", True), ("Además quiero", True), ("¿Qué es? ", False)],
)
def test_compound(spark, question, want):
    assert one(spark, question, text.is_compound) is want


def test_looks_like_question(spark):
    assert [one(spark, q, text.looks_like_question) for q in ("  ¿Que es  ", "Si?", "Una frase.", "Es asi?")] == [True, False, False, True]


@pytest.mark.parametrize(
    ("answer", "context", "want"),
    [
        ("El limite es 28%", "No se menciona el limite", [("numero", "28")]),
        ("El limite es 28%", "era de 128 puntos", []),
        ("En 2025 hubo 12350", "", []),
        ("Hay 5 pasos", "", []),
        ("12 de mayo de 2030", "nada", [("numero", "12"), ("fecha", "12 de mayo de 2030")]),
        ("ARTÍCULO 45b y articulo 45B", "x", [("articulo", "ARTÍCULO 45b")]),
        ("COP 12,350 millones", "son 12,350 de hoy", []),
        (None, None, []),
    ],
)
def test_claims(spark, answer, context, want):
    df = spark.createDataFrame([(1, answer, context)], "id long, answer string, context string")
    assert [(w.kind, w.claim) for w in verify.with_warnings(df).first().warnings] == want
