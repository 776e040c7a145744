"""Usage and quality figures of a query log (ts, question, latency_ms, llm_model, answer, sources, warnings)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions import text


def derived(log: DataFrame) -> DataFrame:
    """log with date, no_match, warnings_count and sources_count."""
    return log.withColumns({
        "date": F.to_date("ts"), "no_match": F.contains(text.fold(F.coalesce("answer", F.lit(""))), F.lit(text.NO_MATCH)),
        "warnings_count": F.coalesce(F.size("warnings"), F.lit(0)), "sources_count": F.coalesce(F.size("sources"), F.lit(0)),
    })


def whole(x: Column) -> Column:
    """Cut to an integer towards zero."""
    return x.cast("long")


def kpis(log: DataFrame, now: Column) -> DataFrame:
    """One row: total, last_7_days, p50_ms, p95_ms, no_match_rate, warning_rate."""
    return log.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("ts") >= now - F.expr("INTERVAL 7 DAYS")).alias("last_7_days"),
        whole(F.median("latency_ms")).alias("p50_ms"), whole(F.percentile("latency_ms", 0.95)).alias("p95_ms"),
        F.round(F.avg(F.col("no_match").cast("double")), 6).alias("no_match_rate"), F.round(F.avg((F.col("warnings_count") > 0).cast("double")), 6).alias("warning_rate"),
    )


def daily(log: DataFrame) -> DataFrame:
    return log.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


def by_model(log: DataFrame) -> DataFrame:
    """n, p50_ms and p95_ms of each model that is named."""
    rows = log.filter(F.col("llm_model").isNotNull()).groupBy("llm_model")
    return rows.agg(F.count("latency_ms").alias("n"), whole(F.median("latency_ms")).alias("p50_ms"), whole(F.percentile("latency_ms", 0.95)).alias("p95_ms"))


def top_questions(log: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent questions with veces, no_match, p50_ms and no_match_rate; ties by question."""
    rows = log.groupBy("question").agg(F.count(F.lit(1)).alias("veces"), F.sum(F.col("no_match").cast("long")).alias("no_match"), F.median("latency_ms").alias("_p50"))
    top = rows.orderBy(F.desc("veces"), "question").limit(n)
    return top.select("question", "veces", "no_match", whole(F.col("_p50")).alias("p50_ms"), F.round(F.col("no_match") / F.col("veces"), 6).alias("no_match_rate"))


def recent(log: DataFrame, n: int = 50) -> DataFrame:
    """The newest n rows, without the embedding model."""
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(n).drop("embedding_model")


def all_queries(log: DataFrame) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("id"))


def purge(log: DataFrame, now: Column, days: int) -> DataFrame:
    """What retention keeps: rows no older than the cutoff."""
    return log.filter(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))


def source_frequencies(log: DataFrame) -> DataFrame:
    """(source, n) of all citations, most cited first; a log without citations gives an empty frame of that shape."""
    return log.select(F.explode("sources").alias("s")).groupBy(F.col("s.source").alias("source")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


def bursts(events: DataFrame, keys: list[str], gap_seconds: float, ts: str = "ts") -> DataFrame:
    """(keys, started, ended, n): runs of events no further apart than the gap (a gap of exactly that length joins)."""
    session = F.session_window(F.col(ts), F.lit(f"{gap_seconds} seconds"))
    rows = events.groupBy(*keys, session).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"))
    return rows.drop("session_window")
