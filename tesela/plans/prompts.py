"""Prompts as string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesela.functions.structured import EXTRACT_CATEGORIES, RISK_LABELS, SUMMARY_FIELDS

ANSWER = "Eres un analista de riesgo financiero. Responde solo con los fragmentos dados, cita sus cifras tal como aparecen y, si no bastan, di que no encuentras esta informacion."
DECOMPOSE = "Separa la pregunta en preguntas simples. Devuelve unicamente un array JSON con hasta tres cadenas, cada una terminada en signo de interrogacion."
#: What the cot technique asks for before the JSON, by task; the last step is the JSON itself.
STEPS = {
    "classify": ("cita las frases que hablan de un riesgo", "di que etiqueta corresponde a cada frase y por que", "pondera las etiquetas segun su presencia en el texto"),
    "extract": ("lee el fragmento y separa hechos de opiniones", "asigna cada hecho a una clave, con sus cifras y fechas", "descarta lo que este repetido"),
    "summarize": ("ordena lo tratado por temas", "separa lo decidido, lo pendiente y quien responde", "reduce cada punto a una linea"),
}

_TASKS = {
    "classify": ("Clasifica el texto por tipo de riesgo. Etiquetas: " + ", ".join(RISK_LABELS) + '. Devuelve un array JSON de objetos {"label", "weight"} con pesos entre 0 y 1.', "Texto:\n"),
    "extract": ("Extrae la informacion clave del fragmento. Devuelve un objeto JSON con las claves " + ", ".join(EXTRACT_CATEGORIES) + ", cada una un array de cadenas.", "Fragmento:\n"),
    "extract_reduce": ("Une las extracciones parciales del documento sin repetir. Devuelve un objeto JSON con las claves " + ", ".join(EXTRACT_CATEGORIES) + ".", "Parciales:\n"),
    "summarize": ("Resume el fragmento del acta. Devuelve un objeto JSON con las claves " + ", ".join(SUMMARY_FIELDS) + ", cada una un array de cadenas.", "Fragmento:\n"),
    "summarize_reduce": ("Une los resumenes parciales del acta sin repetir. Devuelve un objeto JSON con las claves " + ", ".join(SUMMARY_FIELDS) + ".", "Parciales:\n"),
}


def check_technique(technique: str) -> None:
    if technique not in ("zero_shot", "cot"):
        raise ValueError(f"unknown technique: {technique}")


def task_prompt(task: str, technique: str, body: Column, document: Column | None = None) -> tuple[Column, Column]:
    """(system, user) of a task; cot asks for the task's own steps of reasoning first, the JSON as the last; reductions have none."""
    check_technique(technique)
    system, label = _TASKS[task]
    head = F.concat(F.lit("Documento: "), document, F.lit("\n")) if document is not None else F.lit("")
    steps = [*STEPS.get(task, ()), "el JSON, sin nada detras"] if technique == "cot" and task in STEPS else []
    return F.lit(system + "".join(f"\nPASO {i}: {step}." for i, step in enumerate(steps, 1))), F.concat(head, F.lit(label), body)


def answer_prompt(question: Column, context: Column) -> tuple[Column, Column]:
    return F.lit(ANSWER), F.concat(F.lit("Contexto:\n"), context, F.lit("\n\nPregunta: "), question)
