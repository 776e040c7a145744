"""The chunker's queries against a plain implementation of their definition, row by row."""

import hashlib
import re

from tesela.functions import text
from tesela.plans import registry

SF = "/root/testdata/sf0.001"
SIZE, OVERLAP = 900, 150
HEAD = re.compile(text.HEADING.replace("(?dimU)", "(?im)").replace(r"\p{L}\p{N}_", r"\w"))
TABLE = re.compile(r"(?m)(?:^[ \t]*\|.*\|[ \t]*(?:\n|\Z)){2,}")


def segments(page):
    out, rest = [], page
    while m := TABLE.search(rest):
        out += [(rest[: m.start()], False), (m.group(), True)]
        rest = rest[m.end() :]
    out = [(s.strip(), t) for s, t in [*out, (rest, False)]]
    return [x for x in out if x[0]] or [(page, False)]


def cut(body, separators=("\n\n", "\n", ". ", " ", "")):
    """Pieces begin with their separator; a window of pieces slides over the text."""
    while separators[0] and separators[0] not in body:
        separators = separators[1:]
    sep = separators[0]
    pieces = [x for x in re.split(f"(?={re.escape(sep)})", body) if x] if sep else list(body)
    chunks, window = [], []

    def say():
        joined = "".join(window).strip()
        chunks.extend([joined] if joined else [])

    for piece in pieces:
        if len(piece) >= SIZE and sep:
            say()
            window = []
            chunks += cut(piece, separators[1:])
            continue
        if window and sum(map(len, window)) + len(piece) > SIZE:
            say()
            while window and (sum(map(len, window)) > OVERLAP or sum(map(len, window)) + len(piece) > SIZE):
                window = window[1:]
        window = [*window, piece]
    say()
    return chunks


def wanted_chunks(rows):
    out, last = {}, {}
    for source, page, body in sorted(rows):
        made = [c for s, t in segments(body) for c in ([(s, True)] if t else [(x, False) for x in cut(s)]) if c[0].strip()]
        for i, (chunk, is_table) in enumerate(made):
            heads = list(HEAD.finditer(chunk))
            own = heads[0].group(1).strip()[:120] if heads and heads[0].start() <= 0.33 * len(chunk) else ""
            hint = own or last.get(source, "")
            if heads:
                last[source] = heads[-1].group(1).strip()[:120]
            out[f"{source}::p{page}::c{i}"] = (source, page, i, hint, is_table, len(chunk), hashlib.sha256(chunk.encode()).hexdigest())
    return out


def test_chunks_and_hints(spark):
    rows = [(r.source, r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.chunk_id: (r.source, r.page, r.chunk_index, r.section_hint, r.is_table, r.n_chars, r.sha256) for r in registry.QUERIES["recursive_chunks"](spark, SF).collect()}
    want = wanted_chunks(rows)
    assert len({w[3] for w in want.values()}) > 20  # headings do occur
    assert got == want


def test_chunks_of_pages_with_headings_and_tables(spark):
    from tesela.operators.chunks import chunk_pages

    pages = [
        ("a", 1, "  \nARTÍCULO 12 Límites\n\n" + "texto corriente. " * 90 + "\n\nCAPÍTULO IV Otros\nfin"),
        ("a", 2, "| k | v |\n| --- | --- |\n| 1 | 2 |\n\nsin titulo aqui"),
        ("a", 3, "x" * 2000 + "\n3.1.2 Medición del riesgo\n"),
        ("b", 1, ""), ("b", 2, "SECCIÓN σ²_t-1 Modelo\ny más"), ("b", 3, "12"),
    ]
    df = spark.createDataFrame(pages, "source string, page long, text string").selectExpr("*", "'native' AS extraction")
    got = {r.chunk_id: (r.source, r.page, r.chunk_index, r.section_hint, r.is_table, len(r.text), hashlib.sha256(r.text.encode()).hexdigest()) for r in chunk_pages(df).collect()}
    assert got == wanted_chunks(pages)


def test_segments(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {(r.doc_id, r.ord): (r.is_table, r.n_chars, r.sha256) for r in registry.QUERIES["table_segments"](spark, SF).collect()}
    want = {}
    for key, body in rows.items():
        page = f"{body}\n\n| key | value |\n| --- | --- |\n| {key} | x |\n\nfin {key}"
        for i, (s, t) in enumerate(segments(page)):
            want[key, i] = (t, len(s), hashlib.sha256(s.encode()).hexdigest())
    assert got == want
