"""The append-only log of document versions, and the states that are folded from it.

A log row is never changed: it says which upload became which version of a file
name, with checksum, uploader and change note. Which version is current, now or at
a time, follows from the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bindery.operators.ranking import number_within

NAME = ["submission_id", "original_filename"]
LOG = [*NAME, "version_number", "document_id", "checksum_sha256", "uploaded_by", "change_note", "uploaded_at"]


def append(log: DataFrame | None, uploads: DataFrame) -> DataFrame:
    """New log rows of a batch of uploads: numbers go on from the log's, without gaps, in the order of upload.

    Any number of uploads of one name may come in a batch. An upload that is in
    the log already (by document_id) is none again, so a batch can be repeated.
    Missing checksums, uploaders and notes stay null; submission and file name are
    taken to be there.
    """
    rows = uploads
    for c in ("checksum_sha256", "uploaded_by", "change_note"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    if log is None:
        fresh = number_within(rows, NAME, ["uploaded_at", "document_id"], "version_number")
        return fresh.select(*LOG)
    rows = rows.join(log.select("document_id").distinct(), "document_id", "left_anti")
    known = log.groupBy(*NAME).agg(F.max("version_number").alias("_last"))
    fresh = number_within(rows, NAME, ["uploaded_at", "document_id"], "_n")
    return fresh.join(known, NAME, "left").withColumn(
        "version_number", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("int")).select(*LOG)


def state(log: DataFrame, as_of=None) -> DataFrame:
    """The log with ``is_current_version``, as it was at ``as_of`` (inclusive; by default now): later rows are not there yet."""
    seen = log if as_of is None else log.filter(F.col("uploaded_at") <= F.lit(as_of).cast(log.schema["uploaded_at"].dataType))
    # names with a hot history shrink on the mapper
    last = seen.groupBy(*NAME).agg(F.max("version_number").alias("_last"))
    return seen.join(last, NAME).withColumn("is_current_version", F.col("version_number") == F.col("_last")).drop("_last")


def current(log: DataFrame, as_of=None) -> DataFrame:
    """The current version of each file name, with how many there are."""
    seen = log if as_of is None else log.filter(F.col("uploaded_at") <= F.lit(as_of).cast(log.schema["uploaded_at"].dataType))
    rest = [c for c in LOG if c not in NAME]
    return seen.groupBy(*NAME).agg(F.max_by(F.struct(*rest), "version_number").alias("v"), F.count(F.lit(1)).alias("n_versions")) \
        .select(*NAME, "v.*", "n_versions")


def changed_contents(log: DataFrame) -> DataFrame:
    """Versions whose checksum differs from the one before; null checksums are unknown and never differ."""
    before = log.select(*NAME, (F.col("version_number") + 1).alias("version_number"), F.col("checksum_sha256").alias("_before"))
    return log.join(before, [*NAME, "version_number"]).filter(F.col("checksum_sha256") != F.col("_before")).drop("_before")
