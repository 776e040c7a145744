"""Text expressions on columns: cleaning, accents, tokens, headings, claims, tables.  All but the search for claims
stay inside the JVM."""

from __future__ import annotations

import functools
import sys
import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish function words, without accents.
STOPWORDS_ES = (
    """
    a al algo algun alguna algunas alguno algunos ante antes aquel aquella
    aquellas aquello aquellos aqui bajo bien cada como con contra cual cuales
    cuando de del desde donde dos durante e el ella ellas ellos en entre era
    eran eres es esa esas ese eso esos esta estaba estaban estamos estan estar
    este esto estos fue fueron ha habia habian han has hasta hay la las le les
    lo los mas me mi mis mucho muy ni no nos nosotros nuestra nuestras nuestro
    nuestros o os otra otras otro otros para pero poco por porque pues que
    quien quienes se ser si sido siempre sin sobre son soy su sus tambien tan
    tanto te tiene tienen todo todos tu tus un una unas uno unos usted ustedes
    vosotros vuestra vuestras vuestro vuestros y ya yo
    """
).split()

# What makes a heading, a pipe table, a claim, a compound question, and the sign of an answer without result.
HEADING = (
    r"(?dimU)^\s*("
    r"ART[IÍ]CULO\s+\d+[^\n]{0,120}"
    r"|CAP[IÍ]TULO\s+[IVXLCDM\d]+[^\n]{0,120}"
    r"|SECCI[OÓ]N\s+[\p{L}\p{N}_\-\.]+[^\n]{0,120}"
    r"|PARTE\s+[IVXLCDM\d]+[^\n]{0,120}"
    r"|PASO\s+\d+[^\n]{0,120}"
    r"|\d+(?:\.\d+){0,3}[\.\s]+[A-Za-zÁÉÍÓÚÑáéíóúñ][^\n]{2,100}"
    r"|[A-ZÁÉÍÓÚÑ]{3,}(?:\s+[A-ZÁÉÍÓÚÑ\d\-]{2,}){1,8}"
    r")"
)
TABLE = r"(?dm)(?:^[ \t]*\|.*\|[ \t]*(?:\n|\z)){2,}"
NUMBER = r"(?U)\b\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?\s*%?\b"
ARTICLE = r"(?iuU)art[íi]culo\s+\d+[a-z]?"
DATE = r"(?iuU)\b\d{1,2}\s+de\s+[a-záéíóúñ]+\s+de\s+\d{4}\b"
TRIVIAL_NUMBERS = ["1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "100"]
WH_WORDS = r"qu[eé]|c[oó]mo|cu[aá]ndo|cu[aá]nto|cu[aá]l(?:es)?|qui[eé]n(?:es)?|d[oó]nde|por qu[eé]|para qu[eé]"
COMPOUND = rf"(?iuU)\s+y\s+(?:{WH_WORDS})\b|\?\s*[¿\w].*\?|\bademas\b|\badem[aá]s\b"
NO_MATCH = "no encuentro esta informacion"
NO_TITLE = "(sin titulo)"
RULE = "\n\n============================\n\n"

TOKEN = r"[\p{L}\p{N}_]+"
#: A heading is a chunk's own if it starts in this share of the text.
FIRST_PART = 0.33


@functools.cache
def _accents() -> tuple[str, str]:
    """Characters of the basic plane whose decomposition without marks is one other character, these, and then the marks themselves."""
    plain, accented, marks = [], [], []
    for c in map(chr, range(0x80, min(sys.maxunicode, 0xFFFF) + 1)):
        if 0xD800 <= ord(c) <= 0xDFFF:
            continue
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if bare != c and len(bare) == 1:
            accented.append(c)
            plain.append(bare)
    return "".join(accented + marks), "".join(plain)


def strip_accents(text: Column) -> Column:
    """Decompose and drop marks (ñ becomes n).  Exact but for characters that decompose into several letters (Hangul), which stay."""
    return F.translate(text, *_accents())


def trim_all(text: Column) -> Column:
    """Strip all Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def clean(text: Column) -> Column:
    """NUL to space, runs of blanks and tabs to one space, three or more line ends to two, then trim."""
    text = F.regexp_replace(F.replace(text, F.lit("\0"), F.lit(" ")), "[ \t]+", " ")
    return trim_all(F.regexp_replace(text, "\n{3,}", "\n\n"))


def fold(text: Column) -> Column:
    """Without accents, in lower case."""
    return F.lower(strip_accents(text))


def normalized(text: Column) -> Column:
    """Folded, each run of white space one space (not trimmed)."""
    return F.regexp_replace(fold(text), r"(?U)\s+", " ")


def contains_folded(text: Column, part: Column) -> Column:
    return F.contains(fold(text), fold(part))


def tokens(text: Column) -> Column:
    """Words of two or more characters in lower case that are no Spanish stop words; they keep their accents."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    bare = lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(strip_accents(t))  # noqa: E731  (ASCII words have no accents)
    return F.filter(words, lambda t: (F.length(t) > 1) & ~bare(t).isin(STOPWORDS_ES))


def chunk_id(source: Column, page: Column, index: Column) -> Column:
    return F.concat(source, F.lit("::p"), page.cast("string"), F.lit("::c"), index.cast("string"))


def headings(text: Column) -> Column:
    """All headings in order, trimmed and cut at 120 characters."""
    return F.transform(F.regexp_extract_all(text, F.lit(HEADING), F.lit(1)), lambda h: F.substring(trim_all(h), 1, 120))


def section_hint(text: Column) -> Column:
    """The first heading if its match starts in the first third of the text, else ''."""
    at = F.regexp_instr(text, F.lit(HEADING)) - 1
    return F.when((at >= 0) & (at <= F.length(text) * FIRST_PART), F.get(headings(text), 0)).otherwise("")


def is_compound(question: Column) -> Column:
    return question.rlike(COMPOUND)


def looks_like_question(text: Column) -> Column:
    t = trim_all(text)
    return (F.length(t) >= 6) & (t.endswith("?") | t.startswith("¿"))


def _open_claims(kinds: pa.Array, claims: pa.Array, context: pa.Array) -> pa.Array:
    """For each row, which of its claims count and aren't held: the first of a kind that reads the same, no trivial number, and not in the
    context, with or without its spaces.  One pass over either for all claims."""
    out = []
    for kind, claim, body in zip(*(x.to_pylist() for x in (kinds, claims, context)), strict=True):
        firsts: dict[tuple[str, str], int] = {}
        for i, key in enumerate(zip(kind or [], claim or [], strict=True)):
            if key[0] != "numero" or "".join(c for c in key[1] if c in "0123456789") not in TRIVIAL_NUMBERS:
                firsts.setdefault(key, i)
        held: set[str] = set()
        for squeeze in (False, True):
            places: dict[str, list[str]] = {}
            for _, c in firsts:
                places.setdefault(c.replace(" ", "") if squeeze else c, []).append(c)
            searched = ahocorasick.Automaton()
            for c in places:
                if c:
                    searched.add_word(c, c)
            found = {""} & places.keys()
            if len(searched):
                searched.make_automaton()
                for _, c in searched.iter((body or "").replace(" ", "") if squeeze else body or ""):
                    found.add(c)
                    if len(found) == len(places):
                        break
            held.update(x for c in found for x in places[c])
        flags = [False] * len(claim or [])
        for (_, c), i in firsts.items():
            flags[i] = c not in held
        out.append(flags)
    return pa.array(out, pa.list_(pa.bool_()))


def open_claims(claims: Column, context: Column) -> Column:
    """array<boolean> beside an array<struct<kind, claim>>: which of them count and aren't in the context, both read without accents, case and
    runs of white space, or without any of it."""
    wanted = F.transform(claims, lambda c: trim_all(normalized(c.claim)))
    return F.arrow_udf(_open_claims, "array<boolean>")(F.transform(claims, lambda c: c.kind), wanted, normalized(F.coalesce(context, F.lit(""))))


def claims(answer: Column) -> Column:
    """array<struct<kind, claim>> in order of kind (numbers, articles, dates) and place."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(answer, F.lit(pattern), F.lit(0)), lambda c: F.struct(F.lit(kind).alias("kind"), trim_all(c).alias("claim")))

    return F.concat(found("numero", NUMBER), found("articulo", ARTICLE), found("fecha", DATE))


def table_markdown(rows: Column) -> Column:
    """array<array<string>> as a pipe table: the first row heads it, null cells are empty, rows are cut or filled to its width."""
    cell = lambda c: F.replace(F.replace(trim_all(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    width = F.size(F.get(rows, 0))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    fit = lambda r: F.slice(F.concat(F.transform(F.coalesce(r, F.array().cast("array<string>")), cell), F.array_repeat(F.lit(""), width)), F.lit(1), width)
    head, rule = line(fit(F.get(rows, 0))), line(F.array_repeat(F.lit("---"), width))
    body = F.transform(F.filter(rows, lambda _, i: i > 0), lambda r: line(fit(r)))
    return F.when((F.size(rows) > 0) & (width > 0), F.concat(F.array_join(F.concat(F.array(head, rule), body), "\n"), F.lit("\n"))).otherwise("")


def format_context(hits: Column) -> Column:
    """Numbered fragments of array<struct<source, page, section_hint, text>>, in order, parted by a rule."""
    block = lambda h, i: F.concat(
        F.lit("[Fragmento "), (i + 1).cast("string"), F.lit("] Fuente: "), h.source, F.lit(" | Pagina: "), h.page.cast("string"), F.lit(" | Seccion: "),
        F.when(F.coalesce(h.section_hint, F.lit("")) == "", NO_TITLE).otherwise(h.section_hint), F.lit("\n\n"), h.text,
    )
    return F.array_join(F.transform(hits, block), RULE)


def prefer_longer(native: Column, other: Column, few: int = 40) -> Column:
    """A page's native text unless it is short and the other reading is longer."""
    return F.when((F.length(native) < few) & (F.length(other) > F.length(native)), other).otherwise(native)
