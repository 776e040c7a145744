"""Classification, extraction and summaries: map over chunks, reduce by document, merge where the reduction fails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions import structured
from tesela.functions.models import Completer, complete
from tesela.plans.prompts import check_technique, task_prompt


def classify(texts: DataFrame, technique: str, completer: Completer, text: str = "text") -> DataFrame:
    """texts with labels, array<struct<label, weight>>; blank texts are dropped."""
    rows = texts.filter(F.length(F.trim(text)) > 0)
    system, user = task_prompt("classify", technique, F.col(text))
    items = rows.withColumn("_answer", complete(system, user, completer)).withColumn("_items", structured.label_items(F.col("_answer")))
    return items.withColumn("labels", structured.normalized_weights(F.col("_items"))).drop("_answer", "_items")


def merged_items(items: DataFrame, keys: list[str], order: list[str], item: str = "item") -> DataFrame:
    """(keys, items): the ordered union of items, the first spelling of each counting, whatever its case."""
    first = Window.partitionBy(*keys, F.lower(item)).orderBy(*order)
    rows = items.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item")))), lambda x: x["_item"]).alias("items"))


def _map_reduce(chunks: DataFrame, task: str, fields: tuple[str, ...], flatten: bool, technique: str, completer: Completer) -> DataFrame:
    """(source, field, items) with a row for each field of each document."""
    check_technique(technique)
    system, user = task_prompt(task, technique, F.col("text"), F.col("source"))
    parts = chunks.select("source", "page", "chunk_index", structured.field_items(complete(system, user, completer, most=768), fields, flatten).alias("parts"))
    long = parts.select("source", "page", "chunk_index", F.explode("parts").alias("field", "list")).select("source", "page", "chunk_index", "field", F.posexplode("list").alias("at", "item"))
    merged = merged_items(long, ["source", "field"], ["page", "chunk_index", "at"])
    partials = parts.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("page", "chunk_index", F.to_json("parts").alias("json")))).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x.json), "\n")
    system, user = task_prompt(f"{task}_reduce", "zero_shot", body, F.col("source"))
    reduced = partials.select("source", structured.field_items(complete(system, user, completer), fields, flatten).alias("reduced"))
    answered = F.exists(F.map_values("reduced"), lambda v: F.size(v) > 0)
    wide = reduced.select("source", answered.alias("answered"), F.explode("reduced").alias("field", "list"))
    out = wide.join(merged, ["source", "field"], "left")
    none = F.array().cast("array<string>")
    return out.select("source", "field", F.when(F.col("answered"), F.col("list")).otherwise(F.coalesce("items", none)).alias("items"))


def extract(chunks: DataFrame, technique: str, completer: Completer) -> DataFrame:
    return _map_reduce(chunks, "extract", structured.EXTRACT_CATEGORIES, True, technique, completer)


def summarize(chunks: DataFrame, technique: str, completer: Completer) -> DataFrame:
    return _map_reduce(chunks, "summarize", structured.SUMMARY_FIELDS, False, technique, completer)


def items_markdown(results: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(source, markdown): headed lists of each document's fields, in order; empty ones say so."""
    place = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field"))
    lines = F.when(F.size("items") == 0, "- _(sin items)_").otherwise(F.array_join(F.transform("items", lambda i: F.concat(F.lit("- "), i)), "\n"))
    block = F.concat(F.lit("**"), structured.pretty(F.col("field")), F.lit("**\n"), lines, F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("at"), block.alias("block"))))
    return results.groupBy("source").agg(ordered.alias("_b")).select("source", F.concat(F.lit("### "), "source", F.lit("\n"), F.array_join(F.transform("_b", lambda b: b.block), "\n")).alias("markdown"))


def labels_markdown(results: DataFrame, labels: str = "labels") -> DataFrame:
    """results with markdown: a table of the labels, or a line that says there are none."""
    rows = F.array_join(F.transform(labels, lambda x: F.concat(F.lit("| "), structured.pretty(x.label), F.lit(" | "), x.weight.cast("string"), F.lit(" |"))), "\n")
    return results.withColumn("markdown", F.when(F.size(labels) == 0, "_Sin categorias detectadas._").otherwise(F.concat(F.lit("| Categoria | Peso |\n| --- | --- |\n"), rows)))
