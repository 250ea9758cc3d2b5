from pyspark.sql import functions as F

from bindery.operators import issue_evidence as IE
from bindery.plans import validation as P

FIELDS = "submission_id long, document_id long, field_ordinal int, field_name string, confidence double, field_value string"
DOCS = "submission_id long, document_id long, document_type string, is_current_version boolean"


def validated(spark, revenue="$900"):
    rows = [(1, 10, 1, "annual_revenue", 0.9, '{"value": "$100"}'), (1, 10, 2, "annual_revenue", 0.9, f'{{"value": "{revenue}"}}'), (1, 11, 1, "annual_revenue", 0.9, '{"value": "$100"}'),
            (1, 11, 2, "applicant_name", 0.9, '{"value": "Acme Roofing"}'), (1, 12, 1, "applicant_name", 0.9, '{"value": "Borealis Foods"}'),
            (1, 13, 1, "annual_revenue", 0.9, '{"value": "$5"}'), (1, 12, 2, "annual_revenue", None, '{"value": "$7"}'),  # of an untyped document, without confidence
            (2, 20, 1, "contact_email", 0.9, '{"value": "nobody"}')]
    docs = [(1, 10, "ACORD_GL", True), (1, 11, "ACORD_PROPERTY", True), (1, 12, "LOSS_RUN", True), (1, 13, None, True), (2, 20, "ACORD_APPLICATION", True), (3, 30, "OTHER", True)]
    subs = spark.createDataFrame([(1,), (2,), (3,)], "submission_id long")
    return P.run(spark.createDataFrame(rows, FIELDS), spark.createDataFrame(docs, DOCS), subs, "2024-01-01"), subs


def test_evidence_of_conflicts_and_of_single_issues(spark):
    found, _ = validated(spark)
    keyed = IE.with_key(found.violations)
    got = keyed.join(found.evidence, ["submission_id", "issue_key"]).select("issue_type", "field_name", found.evidence["document_id"], "value", "occurrences").collect()
    conflicts = {(r.field_name, r.document_id, r.value, r.occurrences) for r in got if r.issue_type == "CONFLICT"}
    assert conflicts == {("annual_revenue", 10, "$900", 2), ("annual_revenue", 11, "$100", 1), ("applicant_name", 11, "Acme Roofing", 1), ("applicant_name", 12, "Borealis Foods", 1)}
    assert ("contact_email", 20, "nobody", 1) in {(r.field_name, r.document_id, r.value, r.occurrences) for r in got if r.issue_type == "INVALID"}
    missing = [r for r in got if r.issue_type == "MISSING"]
    assert missing and all((r.value, r.occurrences) == (None, 0) for r in missing)
    reach = {r.issue_key: r for r in IE.affected_documents(found.evidence).collect()}
    key = keyed.filter("field_name = 'annual_revenue' and issue_type = 'CONFLICT'").first().issue_key
    assert (reach[key].n_documents, reach[key].n_values) == (2, 2)


def test_refresh_keeps_what_resolved_issues_rested_on(spark):
    first, subs = validated(spark)
    issues = IE.with_key(first.violations).withColumn("is_resolved", (F.col("issue_type") == "CONFLICT") & (F.col("field_name") == "annual_revenue"))
    stored = first.evidence.unionByName(spark.createDataFrame([(9, "other", 90, "x", 1)], first.evidence.schema))
    second, _ = validated(spark, revenue="$700")
    after = IE.refresh_evidence(stored, issues, second.evidence, subs)
    rows = {tuple(r) for r in after.collect()}
    assert len(rows) == after.count()
    old = {tuple(r) for r in first.evidence.join(issues.filter("is_resolved"), ["submission_id", "issue_key"]).select(first.evidence["*"]).collect()}
    new = {tuple(r) for r in second.evidence.collect()}
    assert rows == old | new | {(9, "other", 90, "x", 1)} and {r[3] for r in old} == {"$900", "$100"}
    # the same found again: the resolved issue keeps its evidence, nothing is doubled
    again = IE.refresh_evidence(first.evidence, issues, first.evidence, subs)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in first.evidence.collect()} and again.count() == first.evidence.distinct().count()


def test_keys_tell_null_from_empty(spark):
    rows = spark.createDataFrame([(1, "T", None, "a", "b", None), (1, "T", "", "a", "b", None), (1, "T", "", "ab", "", None)],
                                 "submission_id long, issue_type string, field_name string, title string, description string, document_id long")
    assert IE.with_key(rows).select("issue_key").distinct().count() == 3
