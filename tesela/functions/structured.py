"""Tolerant reading of structured model output."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and fields of the tasks, and how they are shown.
RISK_LABELS = ("riesgo_credito", "riesgo_mercado", "riesgo_operacional", "riesgo_liquidez", "riesgo_ciberseguridad")
EXTRACT_CATEGORIES = ("limites_regulatorios", "indicadores_riesgo", "decisiones_comite", "fechas_criticas")
SUMMARY_FIELDS = ("decisiones", "riesgos_identificados", "acciones_pendientes")
TECHNIQUES = {"zero_shot": "Zero-shot", "cot": "Chain-of-Thought"}
PRETTY = {
    "riesgo_credito": "Credito",
    "riesgo_mercado": "Mercado",
    "riesgo_operacional": "Operacional",
    "riesgo_liquidez": "Liquidez",
    "riesgo_ciberseguridad": "Ciberseguridad",
    "limites_regulatorios": "Limites regulatorios",
    "indicadores_riesgo": "Indicadores de riesgo",
    "decisiones_comite": "Decisiones del comite",
    "fechas_criticas": "Fechas criticas",
    "decisiones": "Decisiones",
    "riesgos_identificados": "Riesgos identificados",
    "acciones_pendientes": "Acciones pendientes",
}

#: Strings whole, then single marks: enough to walk nesting outside of strings.
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[\[\]{}]', re.S)


def balanced(text: str, opener: str, closer: str) -> str | None:
    """The text from the first opener to the closer that balances it, strings skipped; None if there is none."""
    start, depth = text.find(opener), 0
    if start < 0:
        return None
    for m in _MARKS.finditer(text, start):
        depth += (m[0] == opener) - (m[0] == closer)
        if depth == 0 and m[0] == closer:
            return text[start : m.end()]
    return None


def tolerant_json(raw: str | None) -> Any:
    """The value in a model's answer: the whole text, else the first balanced block of the bracket that comes first, else of the other
    kind, each also without commas before a closing bracket; None if nothing parses."""

    def load(text: str) -> tuple[bool, Any]:
        try:
            return True, json.loads(text)
        except (json.JSONDecodeError, RecursionError):
            return False, None

    if not raw:
        return None
    ok, value = load(raw)
    if ok:
        return value
    kinds = sorted((p for p in ("[]", "{}") if p[0] in raw), key=lambda p: raw.find(p[0]))
    for kind in kinds:
        block = balanced(raw, *kind)
        for candidate in () if block is None else (block, re.sub(r",(\s*[}\]])", r"\1", block)):
            ok, value = load(candidate)
            if ok:
                return value
    return None


def parse_json(raw: Column) -> Column:
    """tolerant_json as canonical JSON text, null where nothing parses."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        values = [tolerant_json(x) for x in column.to_pylist()]
        return pa.array([None if v is None else json.dumps(v, ensure_ascii=False) for v in values], pa.string())

    return run(raw)


def item_text(item: Any, flatten: bool) -> str:
    """An item of a list as text; flatten joins an object's non-empty values."""
    if isinstance(item, str):
        return item.strip()
    if flatten and isinstance(item, dict):
        return " - ".join(str(v).strip() for v in item.values() if v)
    return str(item).strip()


def field_items(raw: Column, fields: tuple[str, ...], flatten: bool) -> Column:
    """map<field, array<string>> of a model's answer: all fields always, items as text, empty ones and repeats in other case dropped."""

    @F.arrow_udf("map<string,array<string>>")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            value = tolerant_json(x)
            row = []
            for field in fields:
                items = value.get(field) if isinstance(value, dict) else None
                texts = [t for t in (item_text(i, flatten) for i in items) if t] if isinstance(items, list) else []
                row.append((field, list({t.lower(): t for t in reversed(texts)}.values())[::-1]))
            out.append(row)
        return pa.array(out, pa.map_(pa.string(), pa.list_(pa.string())))

    return run(raw)


def label_items(raw: Column) -> Column:
    """array<struct<label, weight>>: the labelled objects of a model's answer, in order, as they stand (weights that are no numbers null).

    The answer is a list, or an object whose first value that is a non-empty list of objects counts.
    """

    @F.arrow_udf("array<struct<label:string,weight:double>>")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            value = tolerant_json(x)
            if isinstance(value, dict):
                value = next((v for v in value.values() if isinstance(v, list) and v and all(isinstance(i, dict) for i in v)), [])
            rows = []
            for item in value if isinstance(value, list) else []:
                if isinstance(item, dict):
                    try:
                        weight = float(item.get("weight", 0))
                    except (TypeError, ValueError):
                        weight = None
                    rows.append({"label": str(item.get("label", "")), "weight": weight})
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct([("label", pa.string()), ("weight", pa.float64())])))

    return run.asNondeterministic()(raw)  # else it would be run once for each use of the items


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def normalized_weights(items: Column, labels: tuple[str, ...] = RISK_LABELS) -> Column:
    """Known labels with positive weights: the first of each, weights cut at 1, divided by their sum if that is above 1, rounded to four
    places, highest first (ties in order)."""
    named = F.transform(items, lambda x, i: F.struct(F.lower(F.trim(x.label)).alias("label"), F.when(x.weight.isNotNull(), F.least(x.weight, F.lit(1.0))).alias("weight"), i.alias("at")))
    valid = F.filter(named, lambda x: x.label.isin(*labels) & x.weight.isNotNull() & (x.weight > 0) & ~F.isnan(x.weight))
    # what a lambda's body uses again is bound as a variable of its own: written out there, it would be computed again for each item
    first_of = lambda v, own: F.try_element_at(F.filter(v, lambda x: x.label == own), F.lit(1))
    firsts = lambda v: F.array_compact(F.array(*[first_of(v, own) for own in dict.fromkeys(labels)]))
    first = F.array_sort(_once(valid, lambda v: F.transform(firsts(v), lambda x: F.struct(x["at"].alias("at"), x.label.alias("label"), x.weight.alias("weight")))))
    summed = _once(first, lambda f: F.struct(f.alias("first"), F.aggregate(f, F.lit(0.0), lambda a, x: a + x.weight).alias("total")))
    shares = _once(summed, lambda s: F.transform(s.first, lambda x: F.struct((-x.weight).alias("down"), x["at"].alias("at"), x.label.alias("label"), F.round(x.weight / F.greatest(s.total, F.lit(1.0)), 4).alias("weight"))))
    return F.when(items.isNotNull(), F.transform(F.array_sort(shares), lambda x: F.struct(x.label.alias("label"), x.weight.alias("weight"))))


def pretty(slug: Column) -> Column:
    """How a label or field is shown; unknown ones as they are."""
    table = F.create_map(*[F.lit(x) for pair in PRETTY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, slug), slug)
