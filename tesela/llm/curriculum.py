"""Mixing sources to target weights along a time-varying curriculum, in DataFrame expressions only.

Each source gets a target of words; its documents are taken in a fixed shuffled order, pass after pass, until the target is met.  A
source's weight schedule over training time (0 to 1) is piecewise linear; its integral is the share of the target that is consumed by
then.  Inverting that integral at a document's place in its source's order gives the training position of the document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.llm.common import whole_row

#: Hexadecimal digits of each level of the running sums within a source, and how many levels there are.
LEVEL_DIGITS, LEVELS = 2, 2

#: What separates words (ASCII white space only).
WORD = r"[^\x20\x09-\x0D]+"

#: Default schedules by the source's weight: those that weigh more come early, others rise.  Knots are (time, weight).
SCHEDULES: dict[float, Sequence[tuple[float, float]]] = {
    5.0: ((0.0, 1.0), (0.5, 1.0), (1.0, 0.5)),
    2.0: ((0.0, 0.75), (1.0, 1.25)),
    1.0: ((0.0, 0.5), (0.6, 1.0), (1.0, 2.0)),
}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target double) from (source, source_size): weighted shares of budget * all sizes, at most
    most * source_size each, the excess reshared by weight among the rest until none is above.

    Weights repeat over the sources in code-point order, null last.  Water filling has a closed form: in order of the level
    most * size / weight at which a source is full, the full ones are those whose level is at most the level that the rest then share.
    Runs on one row a source.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_k", F.row_number().over(by_name) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_k") % len(weights) + 1))
    cap = F.lit(float(most)) * F.col("source_size")
    level = cap / F.col("weight")
    everything = Window.partitionBy(F.lit(0))
    fill = everything.orderBy(F.col("_level"), F.col("_k"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    full = weighed.withColumn("_level", level).withColumn("_want", F.lit(float(budget)) * F.sum("source_size").over(everything))
    full = full.withColumn("_left", F.col("_want") - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
    full = full.withColumn("_open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the water level if all sources before this one are full and none of the rest is
    full = full.withColumn("_water", F.col("_left") / F.col("_open"))
    settled = full.withColumn("_final", F.min(F.when(F.col("_water") < F.col("_level"), F.struct("_level", "_k", "_water"))).over(everything)["_water"])
    target = F.when(F.col("_final").isNull() | (F.col("_level") <= F.col("_final")), cap).otherwise(F.col("weight") * F.col("_final"))
    return settled.select("source", "source_size", "weight", target.alias("target"))


def _inverse(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which a schedule has consumed that share (0 to 1) of its integral."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    total, done, out = sum(areas), 0.0, None
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        need = F.greatest(share * total - done, F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        # w0 * x + slope / 2 * x**2 = need, solved without cancellation
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0)))
        x = F.when(F.lit(w0) + root > 0, 2 * need / (F.lit(w0) + root)).otherwise(F.lit(0.0))
        here = F.lit(t0) + F.least(x, F.lit(t1 - t0))
        out = here if out is None else F.when(share * total <= done, out).otherwise(here)
        done += area
    return out


def mix_sources(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (5.0, 2.0, 1.0), budget: float = 1.5, most: float = 2.0,
    schedules: dict[float, Sequence[tuple[float, float]]] | None = None, carry: bool = False,
) -> DataFrame:
    """One row per document: (key, source, size, source_size, weight, target, taken long, positions array<double>, copies array<double>).

    taken: words that the mix takes of the document, repeats counted: whole passes over the source in a fixed order, and the last pass
    up to the target rounded down, so the sum over a source is its target to the word and the document at the end is cut there.
    positions: the training position (0 to 1) of each pass in which something of the document is taken; copies: those of the passes
    that take at least half of it, so a mix of whole documents misses a target by at most half a document.  The order within a source is
    that of the key's MD5 (a null key: the text's), then key and size, so reruns agree.  Null text has size 0; documents of size 0 are taken 0 times, and
    so is all of a source without words.  Rows that repeat are documents of their own, whose order among themselves is immaterial.

    carry: return docs' columns first (those with the names of the added ones replaced), then the added ones besides the key.

    Running sums within a source go over two levels of hash prefixes before the documents, so that no window holds a whole source.
    """
    schedules = schedules or SCHEDULES
    added = ["size", "source_size", "weight", "target", "taken", "positions", "copies"]
    row = [whole_row(docs, added)] if carry else []
    rows = docs.select(*row, F.col(key).alias("_key"), F.col(source).alias("_source"), word_count(F.col(text)).alias("_size"), F.md5(F.coalesce(F.col(key).cast("string"), F.col(text), F.lit(""))).alias("_hash"))
    prefixes = [F.substring("_hash", 1, LEVEL_DIGITS * (k + 1)) for k in range(LEVELS)]
    names = [f"_p{k}" for k in range(LEVELS)]
    rows = rows.withColumns(dict(zip(names, prefixes, strict=True)))
    # a null source joins like any other name
    rows = rows.withColumn("_name", F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n")))
    nothing = F.lit(0).cast("long")
    level = rows.groupBy("_name", "_source", *names).agg(F.sum("_size").alias("_sum"))
    sums = [level]
    for k in range(LEVELS - 1, 0, -1):
        sums.append(sums[-1].groupBy("_name", "_source", *names[:k]).agg(F.sum("_sum").alias("_sum")))
    sizes = sums[-1].groupBy("_name", "_source").agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(sizes.select(F.col("_source").alias("source"), "source_size"), weights, budget, most)
    base = targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_name"), "source_size", "weight", "target", nothing.alias("_base"))
    for k, part in enumerate(reversed(sums)):
        on = ["_name", *names[:k]]
        before = Window.partitionBy(*on).orderBy(names[k]).rowsBetween(Window.unboundedPreceding, -1)
        running = part.withColumn("_before", F.coalesce(F.sum("_sum").over(before), nothing)).drop("_sum", "_source")
        base = running.join(base, on).withColumn("_base", F.col("_base") + F.col("_before")).drop("_before")
    last = Window.partitionBy("_name", *names).orderBy("_hash", "_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("_size").over(last), nothing)).join(base, ["_name", *names])
    start, whole = F.col("_base") + F.col("_before"), F.floor("target")
    passes = range(int(most) + (most > int(most)))
    shares = [F.greatest(F.least(whole - (start + F.col("source_size") * p), F.col("_size")), nothing) for p in passes]
    taken = shares[0]
    for share in shares[1:]:
        taken = taken + share
    places = []
    for p, share in zip(passes, shares, strict=True):
        middle = F.try_divide(start + F.col("source_size") * p + share / 2, F.col("target"))
        when = F.lit(None).cast("double")
        for w, knots in schedules.items():
            when = F.when(F.col("weight") == float(w), _inverse(middle, knots)).otherwise(when)
        places.append(F.when(share > 0, F.coalesce(when, middle)))
    # positions of the passes that take at least half of the document, for mixes of whole documents
    copies = F.array(*[F.when((share > 0) & (2 * share >= F.col("_size")), place) for share, place in zip(shares, places, strict=True)])
    return placed.select(
        *(["_row.*"] if carry else [F.col("_key").alias(key), F.col("_source").alias("source")]),
        F.col("_size").alias("size"), "source_size", "weight", "target", taken.alias("taken"),
        F.filter(F.array(*places), lambda x: x.isNotNull()).alias("positions"), F.filter(copies, lambda x: x.isNotNull()).alias("copies"),
    )


def training_order(docs: DataFrame, **mix) -> DataFrame:
    """The mix as whole documents: docs' columns and position double, one row for each copy taken, range-sorted by position.

    Documents of one position are in order of key, then source, then the MD5 of the text (nulls first), so reruns agree.
    """
    mixed = mix_sources(docs, carry=True, **mix)
    rows = mixed.select(whole_row(docs, ["position"]), F.explode("copies").alias("position"))
    # the digest stands for the text, so that a range's bounds stay small
    ties = [F.col(f"_row.{mix.get(name, default)}") for name, default in (("key", "doc_id"), ("source", "source"))]
    return rows.orderBy("position", *ties, F.md5(F.col(f"_row.{mix.get('text', 'text')}"))).select("_row.*", "position")
