"""Text conflicts against a brute-force pass over small groups."""

import difflib
import itertools
import re

from bindery.operators import validate as V
from bindery.plans import validation

NAMES = ["Acme Roofing, Inc.", "ACME ROOFING INC", "Acme Roofing", "Borealis Foods", "", "Zeta & Sons", "zeta sons", "Acme Rofing Inc"]


def brute(groups):
    out = {}
    for key, values in groups.items():
        norms = [re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", v.strip().lower())).strip() for v in values]
        norms = [n for n in norms if n]
        distinct = sorted(set(norms))
        if len(values) < 2 or len(norms) < 2 or len(distinct) < 2:
            continue
        if all(difflib.SequenceMatcher(None, a, b).ratio() >= 0.8 for a, b in zip(distinct, distinct[1:])):
            continue
        out[key] = "Documents provide different values for 'applicant_name': " + ", ".join(repr(d) for d in distinct[:4]) + "."
    return out


def test_text_conflicts(spark):
    groups = {i: list(c) for i, c in enumerate(itertools.chain(
        itertools.combinations(NAMES, 2), itertools.combinations(NAMES, 3), itertools.combinations(NAMES, 6)))}
    rows = [(s, s * 100 + i, 1, "applicant_name", '{"value": "%s"}' % v, 0.9) for s, values in groups.items() for i, v in enumerate(values)]
    fields = spark.createDataFrame(rows, "submission_id long, document_id long, field_ordinal int, field_name string, field_value string, confidence double")
    docs = fields.selectExpr("document_id", "submission_id", "'OTHER' as document_type", "true as is_current_version")
    texts = V.conflict_texts(V.conflict_candidates(V.assemble(fields, docs)))
    found = {r.submission_id: r.description for r in V.text_conflicts(texts, V.conflict_groups(texts)).collect()}
    assert found == brute(groups)


def test_raw_output_is_not_compared(spark):
    rows = [(1, 10, 1, "llm_extraction_output", '{"raw": "a"}', 1.0), (1, 11, 1, "llm_extraction_output", '{"raw": "entirely different"}', 1.0)]
    fields = spark.createDataFrame(rows, "submission_id long, document_id long, field_ordinal int, field_name string, field_value string, confidence double")
    docs = fields.selectExpr("document_id", "submission_id", "'OTHER' as document_type", "true as is_current_version")
    assembled = V.assemble(fields, docs)
    assert V.conflict_candidates(assembled).count() == 0
    assert V.conflict_candidates(assembled, include_raw_output=True).count() == 2


def test_null_representative_goes_to_text(spark):
    rows = [(1, 10, 1, "deductible", '{"value": null}', 1.0), (1, 11, 1, "deductible", '{"value": 5}', 1.0), (1, 12, 1, "deductible", '{"value": 900}', 1.0)]
    fields = spark.createDataFrame(rows, "submission_id long, document_id long, field_ordinal int, field_name string, field_value string, confidence double")
    docs = fields.selectExpr("document_id", "submission_id", "'ACORD_GL' as document_type", "true as is_current_version")
    groups = V.conflict_groups(V.conflict_texts(V.conflict_candidates(V.assemble(fields, docs)))).collect()
    assert [(g.kind, g.n, g.n_texts) for g in groups] == [("text", 3, 2)]


def test_string_document_ids(spark):
    rows = [(1, "b", 1, "fleet_size", '{"value": "few"}', 1.0), (1, "a", 1, "fleet_size", '{"value": 5}', 1.0), (1, "c", 1, "fleet_size", '{"value": 9}', 1.0)]
    fields = spark.createDataFrame(rows, "submission_id long, document_id string, field_ordinal int, field_name string, field_value string, confidence double")
    docs = fields.selectExpr("document_id", "submission_id", "'ACORD_AUTO' as document_type", "true as is_current_version")
    groups = V.conflict_groups(V.conflict_texts(V.conflict_candidates(V.assemble(fields, docs)))).collect()
    assert [g.kind for g in groups] == ["number"]
    subs = spark.createDataFrame([(1,), (2,)], "submission_id long")
    wrong = spark.createDataFrame([(1, "a", 2, "contact_email", '{"value": "none"}', 1.0)], fields.schema)
    result = validation.run(fields.union(wrong), docs.dropDuplicates(["document_id"]), subs)
    ids = {r.document_id for r in result.violations.collect()}
    assert None in ids and ids <= {None, "a", "b", "c"} and len(ids) > 1
    assert {r.submission_id: r.conflict_count for r in result.report.collect()} == {1: 1, 2: 0}
