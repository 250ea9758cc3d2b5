"""Tables that lie together by submission are joined and grouped where they lie."""

from pyspark.sql import functions as F

from bindery.operators import relational as R, validate as V
from bindery.plans import validation as P
from bindery.session import keep_partitions
from bindery.sources import derived
from bindery.sources.derived import SQL, Tables
from checks import load_all
from checks.registry import QUERIES

SF = "/root/testdata/sf0.001"


def tables(spark):
    keep_partitions(spark)
    return Tables(spark, SF)


def test_documents_are_those_of_the_text(spark):
    t = tables(spark)
    ours = t.v_documents
    t.lineitem.createOrReplaceTempView("lineitem")
    text = spark.sql(SQL["v_documents"])
    assert ours.schema == text.schema
    assert ours.exceptAll(text).isEmpty() and text.exceptAll(ours).isEmpty()


def test_candidates_are_grouped_without_another_shuffle(spark, monkeypatch):
    monkeypatch.setattr(derived, "TASK_ROWS", 1000)  # several tasks
    t = tables(spark)
    groups = V.conflict_groups(V.conflict_texts(V.conflict_candidates(V.assemble(t.v_fields, R.assign_versions(t.v_documents)))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = groups._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert shuffles and not any("field_name" in s or "document_id" in s for s in shuffles)


def test_the_report_is_the_same_from_the_written_table(spark):
    t = tables(spark)
    docs = R.assign_versions(t.v_documents)
    a, b = (P.run(t.v_fields, docs, t.v_submissions, "1998-06-01", compare_texts=False, by_submission=x).report for x in (True, False))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert a.agg(F.sum("total_issues")).first()[0] > 0


def test_written_tables_keep_how_they_lie(spark, monkeypatch):
    """Evidence is joined and grouped without a shuffle, with the same rows as from plain tables."""
    monkeypatch.setattr(derived, "TASK_ROWS", 1000)
    t = tables(spark)
    docs = R.assign_versions(t.v_documents)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = (P.run(t.v_fields, docs, t.v_submissions, "1998-06-01", compare_texts=False, by_submission=x) for x in (True, False))
        plan = a.evidence._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange" not in plan
        assert a.violations.count() == b.violations.count()
        x, y = a.evidence, b.evidence
        assert x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty() and not x.isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [x.name for x in spark.catalog.listTables() if x.name.startswith("bindery_")]


def test_evidence_is_not_broadcast_by_an_estimate(spark):
    t = tables(spark)
    a = P.run(t.v_fields, R.assign_versions(t.v_documents), t.v_submissions, "1998-06-01", compare_texts=False, by_submission=True)
    assert "Broadcast" not in a.evidence._jdf.queryExecution().executedPlan().toString()


def test_missing_fields_are_taken_once(spark):
    t = tables(spark)
    facts = V.document_facts(V.last_values(V.assemble(t.v_fields, R.assign_versions(t.v_documents))))
    a, b = V.missing_once(facts), V.deduplicate(V.missing_in_documents(facts))
    assert a.dtypes == b.dtypes and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()


def test_candidates_of_members_are_read_once(spark):
    t = tables(spark)
    load_all()
    plan = QUERIES["g17_conflict_members"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan  # both uses read what was written
    c = V.conflict_candidates(V.assemble(t.v_fields, R.assign_versions(t.v_documents)))
    want = V.conflict_members(c, V.figure_conflicts(V.conflict_groups(V.conflict_texts(c))))
    got = QUERIES["g17_conflict_members"](spark, SF)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not want.isEmpty()
