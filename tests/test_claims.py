import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesela.functions import text
from tesela.operators import verify


def plain(claims, context):
    """Open claims by a search for each."""
    out, seen = [], set()
    for c in claims:
        out.append(c not in seen and c not in context and c.replace(" ", "") not in context.replace(" ", ""))
        seen.add(c)
    return out


@pytest.mark.parametrize(
    ("claims", "context"),
    [
        ([], "x"), (["28%", "28", "8%", "1.234"], "el 28% de 1.2345"), (["articulo 5", "articulo 50"], "articulo 50"), (["a b", "ab", "b c"], "xab c"), (["", "x"], ""),
        (["28 %"] * 3 + ["9"], "28%"), (["12 de mayo de 2030"], "12 demayo de 2030"), (["aba", "bab", "abab"], "xababx"),
    ],
)
def test_one_pass_equals_a_search_for_each(claims, context):
    column = lambda v: pa.array([v, None])
    got = text._open_claims(column(["articulo"] * len(claims)), column(claims), column(context))
    assert got.to_pylist() == [plain(claims, context), []]


def test_claims_of_all_kinds(spark):
    said = "En el Artículo 12b y el ARTICULO  12B se fija 28,5% desde el 3 de Mayo de 2024, 5 pasos y 12 meses."
    rows = [(1, said, ""), (2, said, "articulo12B: 28,5 % el 3 de mayo\nde 2024"), (3, None, "x"), (4, "nada", None), (5, said, said)]
    df = spark.createDataFrame(rows, "id int, answer string, context string")
    got = sorted((r.id, r["at"], r.kind, r.claim) for r in verify.unsupported_claims(df).collect())
    assert [(i, kind, claim) for i, _, kind, claim in got] == [
        (1, "numero", "28,5"), (1, "numero", "12"), (1, "articulo", "Artículo 12b"), (1, "fecha", "3 de Mayo de 2024"),
    ]


def test_many_claims_in_a_long_context(spark):
    n = 3000
    answer = " ".join(f"{i % 900 + 11},{i}" for i in range(n))
    context = " ".join(f"{i % 900 + 11},{i}" for i in range(0, n, 2)) * 20
    df = spark.createDataFrame([(1, answer, context)], "id int, answer string, context string")
    missing = verify.unsupported_claims(df).agg(F.count("claim")).first()[0]
    assert 0 < missing <= n // 2
