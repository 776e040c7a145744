"""Claims of answers against their contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.functions import text


def _checked(answers: DataFrame, answer: str, context: str) -> DataFrame:
    """answers with _open, an array<struct<at, kind, claim>> of an answer's claims that the context doesn't hold; at orders them.

    Claims of a kind that read the same when normalised count once, the first; numbers that are trivial don't count.  All inside the row,
    and a context is read once for all claims.
    """
    # claims are found in a projection of their own, as they are used more than once
    found = answers.withColumn("_claims", text.claims(F.coalesce(F.col(answer), F.lit(""))))
    told = found.withColumn("_flags", text.open_claims(F.col("_claims"), F.col(context)))
    numbered = F.zip_with("_claims", "_flags", lambda c, left: F.struct(c.kind.alias("kind"), c.claim.alias("claim"), left.alias("left")))
    named = F.transform(numbered, lambda c, i: F.struct(i.alias("at"), c.kind.alias("kind"), c.claim.alias("claim"), c.left.alias("left")))
    kept = F.transform(F.filter(named, lambda c: c.left), lambda c: F.struct(c["at"].alias("at"), c.kind.alias("kind"), c.claim.alias("claim")))
    return told.withColumn("_open", kept).drop("_claims", "_flags")


def unsupported_claims(answers: DataFrame, key: str = "id", answer: str = "answer", context: str = "context") -> DataFrame:
    """(key, kind, claim, at), a row for each claim that the context doesn't hold."""
    rows = _checked(answers, answer, context).select(key, F.explode("_open").alias("c"))
    return rows.select(key, "c.kind", "c.claim", "c.at")


def with_warnings(answers: DataFrame, key: str = "id", answer: str = "answer", context: str = "context") -> DataFrame:
    """answers with warnings, an ordered array<struct<kind, claim>>, empty where all is supported."""
    warned = _checked(answers, answer, context).withColumn("warnings", F.transform("_open", lambda w: F.struct(w.kind.alias("kind"), w.claim.alias("claim"))))
    return warned.drop("_open")


def explode_warnings(log: DataFrame) -> DataFrame:
    """(ts, question cut at 80, kind, claim), a row a warning."""
    return log.select("ts", F.substring("question", 1, 80).alias("question"), F.explode("warnings").alias("w")).select("ts", "question", "w.kind", "w.claim")
