"""What an issue rests on: documents and values, as rows beside the issues.

An issue is known by a key derived from its content, so a validation that finds
the same again names the same issue. Evidence is a child table (issue_key,
document, value, occurrences): a conflict may rest on any number of documents, and
no issue carries them in one value.

Joins are merged where rows lie: what fields and issues are made of is small,
so Spark would take them for small tables and broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CONTENT = ("submission_id", "issue_type", "field_name", "title", "description", "document_id")
EVIDENCE = ("submission_id", "issue_key", "document_id", "value", "occurrences")
_NONE, _NEXT = "\x1e", "\x1f"  # stand for null and between columns


def issue_key() -> Column:
    """SHA-256 of what the issue says; null and empty differ."""
    return F.sha2(F.concat_ws(_NEXT, *[F.coalesce(F.col(c).cast("string"), F.lit(_NONE)) for c in CONTENT]), 256)


def with_key(issues: DataFrame) -> DataFrame:
    return issues.withColumn("issue_key", issue_key())


def document_values(assembled: DataFrame) -> DataFrame:
    """Last value of each field of each document, and how many it had."""
    return assembled.groupBy("submission_id", "document_id", "field_name").agg(F.max_by("value", "field_ordinal").alias("value"), F.count(F.lit(1)).alias("occurrences"))


def conflict_evidence(conflicts: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (submission_id, issue_key, document_id, value, occurrences): for each conflict the documents that state the field."""
    keyed = with_key(conflicts).select("submission_id", "field_name", "issue_key").distinct()
    # columns of its own: evidence is joined with the issues, which are made of the same fields
    return keyed.join(members.hint("merge"), ["submission_id", "field_name"]).select(*[F.col(c).alias(c) for c in EVIDENCE])


def single_evidence(violations: DataFrame, values: DataFrame) -> DataFrame:
    """The same of issues of one document: the last value of the field there, null with 0 occurrences where it has none.

    Issues of equal content share it. The key stands for all of the content, so
    the long texts are not carried on.
    """
    keyed = with_key(violations).filter("document_id is not null").select("submission_id", "document_id", "field_name", "issue_key").distinct()
    return keyed.join(values.hint("merge"), ["submission_id", "document_id", "field_name"], "left") \
        .withColumn("occurrences", F.coalesce("occurrences", F.lit(0))).select(*EVIDENCE)


def issue_evidence(violations: DataFrame, members: DataFrame, assembled: DataFrame) -> DataFrame:
    """Rows (submission_id, issue_key, document_id, value, occurrences) of all violations.

    A conflict has a row for each document that states the field: its last value
    and how many it had. Any other issue of a document has one row: the last
    value of its field there, null with 0 occurrences where it has none. Issues of
    no document have no evidence. Issues of equal content share it.
    """
    shared = conflict_evidence(violations.filter("issue_type = 'CONFLICT'"), members)
    return shared.unionByName(single_evidence(violations.filter("issue_type <> 'CONFLICT'"), document_values(assembled)))


def affected_documents(evidence: DataFrame) -> DataFrame:
    """(submission_id, issue_key, n_documents, n_values): how far each issue reaches; shrinks on the mapper."""
    return evidence.groupBy("submission_id", "issue_key").agg(F.count_distinct("document_id").alias("n_documents"), F.count_distinct("value").alias("n_values"))


def refresh_evidence(stored: DataFrame, issues: DataFrame, fresh: DataFrame, validated: DataFrame) -> DataFrame:
    """Evidence after a validation: that of resolved issues and of other submissions stays, the rest gives way to ``fresh``.

    ``issues``: the stored issues with ``issue_key`` and ``is_resolved``. An issue
    that is found again after it was resolved keeps the evidence it had then.
    """
    done = validated.select("submission_id").distinct().withColumn("_validated", F.lit(True))
    settled = issues.filter("is_resolved").select("submission_id", "issue_key").distinct().withColumn("_resolved", F.lit(True))
    settled = settled.hint("merge")
    marked = stored.join(done.hint("merge"), "submission_id", "left").join(settled, ["submission_id", "issue_key"], "left")
    kept = marked.filter(F.col("_resolved") | F.col("_validated").isNull()).select(*EVIDENCE)
    new = fresh.join(settled, ["submission_id", "issue_key"], "left_anti").select(*EVIDENCE)
    return kept.unionByName(new)
