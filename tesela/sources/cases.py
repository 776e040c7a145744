"""Evaluation cases and reports as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = "id string, level string, question string, expected_sources array<string>, must_contain array<string>, must_contain_any_of array<string>, notes string"
CLASSIFICATION = "id string, text string, expected array<string>"
DOCUMENT = "id string, doc string, expected_keywords map<string,array<string>>"
ASSISTANT = f"classification array<struct<{CLASSIFICATION.replace(' ', ':').replace(',:', ',')}>>, extraction array<struct<id:string,doc:string,expected_keywords:map<string,array<string>>>>, summary array<struct<id:string,doc:string,expected_keywords:map<string,array<string>>>>"


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question cases, one JSON object a line; blank lines are skipped."""
    return spark.read.schema(QUESTIONS).json(path).filter(F.col("id").isNotNull())


def load_assistant_cases(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The cases of one kind (classification, extraction, summary) of a JSON document that holds all."""
    whole = spark.read.schema(ASSISTANT).json(path, multiLine=True)
    return whole.select(F.inline(kind))


def expected_keywords(cases: DataFrame) -> DataFrame:
    """(id, doc, field, keywords) of document cases."""
    return cases.select("id", "doc", F.explode("expected_keywords").alias("field", "keywords"))


def write_report(report: DataFrame, path: str) -> None:
    """One JSON file; reports are a few rows."""
    report.coalesce(1).write.mode("overwrite").json(path)
