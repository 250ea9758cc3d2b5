"""Landed files, delimited text and the parsed-output table."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bindery import fixed
from bindery.sources import store


def landed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below ``path``/<submission>/...: submission_id, filename, size, content and SHA-256."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path))
    return files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("submission_id"), F.substring_index("path", "/", -1).alias("filename"),
        "path", "modificationTime", F.col("length").alias("size_bytes"), "content")


def with_checksum(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("checksum_sha256", F.sha2(F.col(content), 256))


def decode(content: Column) -> tuple[Column, Column]:
    """(text, encoding): the first of UTF-8 with or without mark, else Latin-1, which never fails."""
    marked = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    is_utf8 = F.is_valid_utf8(content.cast("string"))
    body = F.when(marked, F.expr("substring(content, 4)")).otherwise(content)
    text = F.when(is_utf8, body.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return text, F.when(is_utf8, "utf-8-sig").otherwise("latin-1")


@F.pandas_udf(T.StringType())
def _sniffed(heads):
    """``csv.Sniffer`` on the head of each file; it also weighs quoting, which no expression does."""
    def one(head):
        try:
            return csv.Sniffer().sniff(head, delimiters="".join(fixed.CSV_DELIMITERS)).delimiter
        except csv.Error:
            return ","
    return heads.map(one)


def sniff_delimiters(files: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``delimiter`` from the first 4 096 characters; only those reach Python."""
    return files.withColumn("delimiter", _sniffed(F.substring(F.coalesce(F.col(text), F.lit("")), 1, fixed.CSV_SNIFF_CHARS)))


def file_heads(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(path, text) of the first characters of every delimited file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    # four bytes a character at most, so this covers the sniffed head
    head = F.substring(F.col("content"), 1, 4 * fixed.CSV_SNIFF_CHARS)
    return files.select("path", head.alias("content")).select("path", decode(F.col("content"))[0].alias("text"))


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, empty cells null, malformed rows tolerated."""
    return (spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding).option("mode", "PERMISSIVE")
            .option("nullValue", "").option("recursiveFileLookup", "true").csv(path))


def unique_names(header: list[str]) -> list[str]:
    """A blank name becomes ``Unnamed: <place>``; a repeated one gets the first free ``.1``, ``.2``, ..."""
    names: list[str] = []
    for i, name in enumerate(header):
        name = name or f"Unnamed: {i}"
        free, n = name, 0
        while free in names:
            n += 1
            free = f"{name}.{n}"
        names.append(free)
    return names


_CELLS = T.ArrayType(T.StringType())


@F.pandas_udf(T.StructType([T.StructField("raw", T.ArrayType(_CELLS)), T.StructField("rejects", T.ArrayType(T.StructType([
    T.StructField("line", T.IntegerType()), T.StructField("cells", _CELLS)])))]))
def _csv_rows(texts: pd.Series, delimiters: pd.Series) -> pd.DataFrame:
    """One uploaded file each: unique header names, cells as text, empty cells null, blank lines left out; longer rows apart."""
    def one(text, delimiter):
        reader, rows, rejects = csv.reader(io.StringIO(text or ""), delimiter=delimiter or ","), [], []
        for r in reader:
            if not rows and r:
                rows.append(unique_names(r))
            elif r and len(r) > len(rows[0]):
                rejects.append({"line": reader.line_num, "cells": r})
            elif r:
                rows.append([c or None for c in r] + [None] * (len(rows[0]) - len(r)))
        return rows, rejects
    return pd.DataFrame([one(t, d) for t, d in zip(texts, delimiters)], columns=["raw", "rejects"])


def csv_documents(files: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Delimited files of any encoding and delimiter, one row per file: encoding, delimiter, raw cells, rejects.

    ``rejects`` are the rows with more cells than the header (``csv_rejects``
    lists them). All rows are kept; ``truncated`` only says that there are more
    than ``max_rows``. For uploads, which are at most 50 MB each; large tables
    go through ``read_delimited``, which splits files.
    """
    text, encoding = decode(F.col("content"))
    decoded = files.select(*[c for c in files.columns if c != "content"], text.alias("_text"), encoding.alias("encoding"))
    parsed = sniff_delimiters(decoded, "_text").withColumn("_parsed", _csv_rows("_text", "delimiter")).drop("_text")
    over = F.lit(False) if max_rows is None else truncated_flag(F.size("_parsed.raw") - 1, max_rows)
    return parsed.select(*[c for c in parsed.columns if c != "_parsed"], "_parsed.raw", "_parsed.rejects", over.alias("truncated"))


def csv_rejects(parsed: DataFrame, key: str = "path") -> DataFrame:
    """Rows that did not fit their header: file, line number, cells."""
    return parsed.select(key, F.explode("rejects").alias("r")).select(key, "r.line", "r.cells")


def truncated_flag(row_count: Column, max_rows: int = fixed.CSV_MAX_ROWS) -> Column:
    return row_count > max_rows


def save_parsed(documents: DataFrame, path: str, buckets: int = 64) -> None:
    """Parsed documents as a stored table, split by a hash of the submission.

    A folder per submission would be millions of tiny folders; buckets keep a
    look-up to one of ``buckets`` folders and the file count bounded.
    """
    store.create(documents, path, "submission_id", buckets)


def replace_parsed(documents: DataFrame, path: str) -> None:
    """Parsed documents in place of what is stored for the same documents; only their buckets are written."""
    store.replace(documents, path, ["submission_id", "document_id"])


def load_parsed(spark: SparkSession, path: str, submission_id=None) -> DataFrame:
    """The stored documents, or those of one submission, which lie in one bucket."""
    return store.load(spark, path, submission_id)
