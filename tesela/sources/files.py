"""Corpus folders as pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import text

SUFFIXES = ("pdf", "txt", "md")
FILES = "source string, suffix string, content binary, sha256 string"
PAGES = "source string, page int, text string, extraction string"

#: A parser gives a file's pages: (text outside tables, tables as markdown, text by OCR or '').
PageParser = Callable[[bytes], list[tuple[str, list[str], str]]]


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)\z", 1)


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1))


def is_supported(name: Column) -> Column:
    return suffix_of(name).isin(*SUFFIXES)


def is_minutes(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("acta"))


def corpus_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source, suffix, content, sha256) of the supported files of a folder, sub-folders left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = base_name(F.col("path"))
    return raw.select(name.alias("source"), suffix_of(name).alias("suffix"), "content", F.sha2("content", 256).alias("sha256")).filter(is_supported(F.col("source")))


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where that fails; line ends become \\n, and a byte-order mark stays."""
    utf8 = content.cast("string")
    read = F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(content, "iso-8859-1"))
    return F.regexp_replace(read, "\r\n?", "\n")


def text_pages(files: DataFrame) -> DataFrame:
    """A text file is one page, cleaned; empty ones are dropped."""
    pages = files.filter(F.col("suffix") != "pdf").select("source", F.lit(1).alias("page"), text.clean(decoded(F.col("content"))).alias("text"), F.lit("text").alias("extraction"))
    return pages.filter(F.col("text") != "")


PARSED = "source string, page int, body string, tables array<string>, ocr string, error string"


def parsed_files(files: DataFrame, parser: PageParser) -> DataFrame:
    """PARSED rows of the PDF files: a row a page, numbered from 1, or one with the error where the parser rejects a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for source, content in zip(batch["source"], batch["content"], strict=True):
                try:
                    pages = parser(bytes(content))
                except Exception as e:  # noqa: BLE001  a broken file must not stop the corpus
                    rows.append((source, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                rows += [(source, i, body, tables, ocr, None) for i, (body, tables, ocr) in enumerate(pages, 1)]
            out = pd.DataFrame(rows, columns=["source", "page", "body", "tables", "ocr", "error"])
            yield out.astype({"page": "Int32"})

    return files.filter(F.col("suffix") == "pdf").select("source", "content").mapInPandas(run, PARSED)


def failed_files(parsed: DataFrame) -> DataFrame:
    """(source, error) of the files that the parser rejected."""
    return parsed.filter(F.col("error").isNotNull()).select("source", "error")


def parsed_pages(parsed: DataFrame) -> DataFrame:
    """The pages of parsed_files(): text and tables; one with little text and no table takes its OCR text if longer; empty ones are dropped."""
    raw = parsed.filter(F.col("error").isNull())
    native = text.clean(F.array_join(F.concat(F.array("body"), F.col("tables")), "\n\n"))
    scanned = (F.size("tables") == 0) & (text.prefer_longer(native, text.clean(F.col("ocr"))) != native)
    pages = raw.select("source", "page", F.when(scanned, text.clean(F.col("ocr"))).otherwise(native).alias("text"), F.when(scanned, "ocr").otherwise("native").alias("extraction"))
    return pages.filter(F.col("text") != "")


def pdf_pages(files: DataFrame, parser: PageParser) -> DataFrame:
    """PDF files by an injected parser, as parsed_pages(); failed_files(parsed_files()) has those that it rejects."""
    return parsed_pages(parsed_files(files, parser))


def corpus_pages(files: DataFrame, parser: PageParser | None = None) -> DataFrame:
    """All pages of files; PDF files need a parser and have no pages without one."""
    pages = text_pages(files)
    return pages.unionByName(pdf_pages(files, parser)) if parser else pages


def document_chunks(collection: DataFrame, files: DataFrame, source: str) -> DataFrame:
    """The indexed chunks of a document by page and place; a text file that isn't indexed is one chunk of its raw text."""
    indexed = collection.filter(F.col("source") == source)
    raw = files.filter((F.col("source") == source) & (F.col("suffix") != "pdf")).join(indexed.select("source").distinct(), "source", "left_anti")
    whole = raw.select("source", F.lit(1).alias("page"), F.lit(0).alias("chunk_index"), decoded(F.col("content")).alias("text"))
    return indexed.select("source", "page", "chunk_index", "text").unionByName(whole).orderBy("page", "chunk_index")
