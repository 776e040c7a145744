"""Pages to citable chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions import chunking, text
from tesela.sources.stage import staged


def inherited_hint(own: Column, last_heading: Column, window, before: Column | None = None) -> Column:
    """A chunk's own hint, else the last heading of earlier chunks in its window, else what was known before the window, else ''."""
    earlier = F.last(last_heading, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.when(own != "", own), earlier, *([before] if before is not None else []), F.lit(""))


def chunk_pages(pages: DataFrame, size: int = 900, overlap: int = 150) -> DataFrame:
    """(source, page, text, extraction) to chunks (chunk_id, source, page, chunk_index, text, extraction, section_hint, is_table).

    Tables are chunks of their own; chunk_index restarts on each page; hints are inherited along a source's pages.  What goes through the
    window over a source is a page's last heading; chunks are dealt by page.
    """
    parts = pages.select("source", "page", "extraction", F.posexplode(chunking.chunk_texts(F.col("text"), size, overlap)).alias("chunk_index", "c"))
    rows = parts.select("source", "page", "extraction", "chunk_index", F.col("c.text").alias("text"), F.col("c.is_table").alias("is_table"))
    rows = staged(rows.withColumn("_own", text.section_hint(F.col("text"))).withColumn("_last", F.try_element_at(text.headings(F.col("text")), F.lit(-1))))
    headed = rows.groupBy("source", "page").agg(F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("chunk_index"))).alias("_heading"))
    before = F.last("_heading", ignorenulls=True).over(Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    carried = headed.select(F.col("source").alias("_source"), F.col("page").alias("_page"), before.alias("_carried"))
    rows = rows.join(carried, F.col("source").eqNullSafe(F.col("_source")) & F.col("page").eqNullSafe(F.col("_page")))
    hint = inherited_hint(F.col("_own"), F.col("_last"), Window.partitionBy("_source", "_page").orderBy("chunk_index"), F.col("_carried"))
    return rows.select(text.chunk_id(F.col("source"), F.col("page"), F.col("chunk_index")).alias("chunk_id"), "source", "page", "chunk_index", "text", "extraction", hint.alias("section_hint"), "is_table")


def outside_boxes(objects: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Objects (keys, x0, top, x1, bottom) that no box of the same keys strictly contains.

    The keys (a document's page) make it an equi-join, so only boxes of one page meet.
    """
    b = boxes.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in ("x0", "top", "x1", "bottom")])
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    inside = [F.col("x0") > F.col("_x0"), F.col("top") > F.col("_top"), F.col("x1") < F.col("_x1"), F.col("bottom") < F.col("_bottom")]
    return objects.join(b, [*same, *inside], "left_anti")
