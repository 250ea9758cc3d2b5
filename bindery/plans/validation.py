"""The whole validation of many submissions as one plan."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from bindery.operators import validate as V
from bindery.operators.issue_evidence import conflict_evidence, document_values, single_evidence
from bindery.session import shared_dir


@dataclass
class Validation:
    violations: DataFrame          # all violations, one row each
    conflicts: DataFrame           # the CONFLICT rows among them
    members: DataFrame             # documents and values of each conflict
    report: DataFrame              # counts per submission
    evidence: DataFrame            # documents and values of each issue


def _tasks(df: DataFrame) -> int | None:
    """Number of tasks in which ``df`` lies by a hash of ``submission_id``; None if it does not."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.initialPlan()
    found = re.search(r"hashpartitioning\(submission_id#\d+L?, (\d+)\)", plan.outputPartitioning().toString())
    return int(found.group(1)) if found else None


def _table(df: DataFrame, path: str, tasks: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder; with ``tasks`` in as many buckets of submissions, which is how its rows lie when they are read."""
    spark = df.sparkSession
    if not tasks:
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    if _tasks(df) != tasks:
        df = df.repartition(tasks, "submission_id")
    name = f"bindery_{uuid.uuid4().hex}"  # only the catalogue tells a reader of buckets; the files stay
    df.write.bucketBy(tasks, "submission_id").option("path", path).format("parquet").saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"drop table {name}")


def kept_together(df: DataFrame) -> DataFrame:
    """``df`` written once, for several uses; if it lies together by submission it is read so."""
    return _table(df, shared_dir(df.sparkSession, "kept"), _tasks(df))


def run(fields: DataFrame, documents: DataFrame, submissions: DataFrame, as_of: str | None = None,
        compare_texts: bool = True, scratch: str | None = None, by_submission: bool = False) -> Validation:
    """Validates every submission in ``submissions``.

    ``documents`` carries ``is_current_version``. Some results feed several
    rules each: the current documents, the types per submission, the assembled fields, the facts per
    document and the distinct texts per field. They are written once below ``scratch`` (by default a new
    folder under the cluster's checkpoint folder) and read from there, so no
    rule repeats the joins and a lost executor costs only its own tasks.

    ``by_submission``: both tables lie together by submission. Then the written
    tables have a bucket for each task, and what is grouped and joined by
    submission is so where it lies, without another shuffle.
    """
    scratch = scratch or shared_dir(fields.sparkSession, "validation")
    documents = documents.filter("is_current_version").select("submission_id", "document_id", "document_type", "is_current_version")
    tasks = _tasks(documents) if by_submission else None

    def table(name: str, df: DataFrame) -> DataFrame:
        return _table(df, f"{scratch}/{name}", tasks)

    documents = table("documents", documents)
    # a row of the documents takes many times in a broadcast what it takes in a file
    assembled = table("assembled", V.assemble(fields, documents.hint("merge") if tasks else documents).drop("field_value"))
    facts = table("facts", V.document_facts(V.last_values(assembled)))
    texts = table("texts", V.conflict_texts(V.conflict_candidates(assembled)))
    types = table("types", V.present_types(documents))
    submissions = table("submissions", submissions.select("submission_id"))
    groups = V.conflict_groups(texts)
    conflicts = V.figure_conflicts(groups)
    if compare_texts:
        conflicts = conflicts.unionByName(V.text_conflicts(texts, groups))
    # no two of these rules give issues of equal content
    of_documents = [V.field_violations(assembled, as_of), V.date_order_violations(facts), V.revenue_per_employee_violations(facts), V.missing_once(facts)]
    of_submissions = [V.missing_everywhere(submissions, facts), V.missing_forms(V.lines_requested(assembled), types), V.submission_rule_violations(submissions, types)]
    violations = reduce(DataFrame.unionByName, [*of_documents, conflicts, *of_submissions])
    members = V.conflict_members(V.comparable(assembled), conflicts)
    values = document_values(assembled)
    evidence = reduce(DataFrame.unionByName, [conflict_evidence(conflicts, members), *[single_evidence(v, values) for v in of_documents]])
    return Validation(violations, conflicts, members, V.report_counts(submissions, violations), evidence)
