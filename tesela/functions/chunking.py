"""Splitting pages into segments and chunks inside Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Places to cut at, the first that occurs in a text first ('' cuts anywhere), and pipe tables.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
_TABLE = re.compile(r"(?:^[ \t]*\|.*\|[ \t]*(?:\n|\Z)){2,}", re.M)


def split_tables(text: str) -> list[tuple[str, bool]]:
    """Prose and pipe tables (two rows or more) in turn, trimmed, without empty ones; a text without tables is one prose segment."""
    out, at = [], 0
    for m in _TABLE.finditer(text):
        out += [(text[at : m.start()].strip(), False), (m[0].strip(), True)]
        at = m.end()
    out.append((text[at:].strip(), False))
    return [x for x in out if x[0]] or [(text, False)]


def recursive_split(text: str, size: int = 900, overlap: int = 150, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters, neighbours sharing at most `overlap`, cut at the coarsest separator that serves.

    A separator stays with the piece that it precedes.  Pieces that are too long themselves are cut at the next separators.
    """
    sep = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(sep) + 1 :]
    if sep:
        first, *others = text.split(sep)
        pieces = [p for p in (first, *(sep + o for o in others)) if p]
    else:
        pieces = list(text)
    chunks: list[str] = []
    held: list[str] = []
    total = 0

    def emit() -> None:
        if made := "".join(held).strip():
            chunks.append(made)

    for piece in pieces:
        n = len(piece)
        if n >= size and rest:
            emit()
            held, total = [], 0
            chunks += recursive_split(piece, size, overlap, rest)
            continue
        if total + n > size and held:
            emit()
            while total > overlap or (total and total + n > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += n
    emit()
    return chunks


def chunk_texts(text: Column, size: int = 900, overlap: int = 150) -> Column:
    """array<struct<text, is_table>>: each table one chunk, prose cut by recursive_split."""

    @F.arrow_udf("array<struct<text:string,is_table:boolean>>")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for page in column.to_pylist():
            made = []
            for segment, is_table in split_tables(page or ""):
                made += [(segment, True)] if is_table else [(c, False) for c in recursive_split(segment, size, overlap)]
            out.append([{"text": t, "is_table": k} for t, k in made if t.strip()])
        return pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("is_table", pa.bool_())])))

    return run(text)


def table_segments(text: Column) -> Column:
    """array<struct<text, is_table>> of split_tables."""

    @F.arrow_udf("array<struct<text:string,is_table:boolean>>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([[{"text": t, "is_table": k} for t, k in split_tables(x or "")] for x in column.to_pylist()], pa.list_(pa.struct([("text", pa.string()), ("is_table", pa.bool_())])))

    return run(text)
