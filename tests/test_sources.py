import csv
import os

import pytest
from pyspark.sql import functions as F

from bindery.operators import guardrails as G, ingest as I
from bindery.sources import files as S
from bindery.streaming import pending


def test_decode(spark):
    rows = [(1, b"\xef\xbb\xbfa;b"), (2, "café".encode()), (3, b"caf\xe9")]
    df = spark.createDataFrame(rows, "i int, content binary")
    text, encoding = S.decode(F.col("content"))
    got = [(r.t, r.e) for r in df.select("i", text.alias("t"), encoding.alias("e")).orderBy("i").collect()]
    assert got == [("a;b", "utf-8-sig"), ("café", "utf-8-sig"), ("café", "latin-1")]


def test_sniff(spark):
    texts = ["a,b\n1,2\n", "a\tb\n1\t2\n", "a|b\n1|2\n", "a;b\n1;2\n", "no table here", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.delimiter for r in S.sniff_delimiters(df).orderBy("i").collect()]

    def expected(t):
        try:
            return csv.Sniffer().sniff(t, delimiters=",\t|;").delimiter
        except csv.Error:
            return ","
    assert got == [expected(t) for t in texts]


def test_read_delimited_keeps_text_and_short_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c\n007,,x\n1,2\n")
    rows = [tuple(r) for r in S.read_delimited(spark, str(tmp_path)).collect()]
    assert rows == [("007", None, "x"), ("1", "2", None)]


def test_landed_files(spark, tmp_path):
    os.makedirs(tmp_path / "S1")
    (tmp_path / "S1" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    row = S.with_checksum(S.landed_files(spark, str(tmp_path))).collect()[0]
    assert (row.submission_id, row.filename, row.size_bytes) == ("S1", "a.pdf", 10)
    assert len(row.checksum_sha256) == 64
    assert I.resolve_mime(S.landed_files(spark, str(tmp_path))).first().mime_type == "application/pdf"


def test_parsed_table_by_submission(spark, tmp_path):
    docs = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "submission_id long, document_id long, full_text string")
    S.save_parsed(docs, str(tmp_path / "p"), buckets=4)
    got = S.load_parsed(spark, str(tmp_path / "p"), 2)
    assert [tuple(r) for r in got.select(*docs.columns).collect()] == [(2, 20, "b")]


def test_row_maps_keep_last_duplicate_header(spark):
    df = spark.createDataFrame([([["h", "h"], ["1", "2"]],)], "raw array<array<string>>")
    row = I.to_table(df).select(I.row_maps(F.col("headers"), F.col("rows")).alias("m")).first()
    assert row.m == [{"h": "2"}]


def test_stream_takes_each_document_once(spark, tmp_path):
    landed, out, ck = (str(tmp_path / n) for n in ("landed", "out", "ck"))
    schema = "document_id long, file_extension string, text string"

    def land(*ids):
        spark.createDataFrame([(i, "pdf", "Loss Run: claim number, claimant, adjuster. Bearer abc") for i in ids], schema).coalesce(1) \
            .write.mode("append").parquet(landed)

    def run():
        stream = pending.stream_documents(spark, landed, spark.read.parquet(landed).schema)
        pending.run_available(pending.process(stream, 4000), out, ck)
        return sorted(r.document_id for r in spark.read.parquet(out).collect())

    land(1, 2)
    assert run() == [1, 2]
    assert run() == [1, 2]
    land(3)
    assert run() == [1, 2, 3]
    row = spark.read.parquet(out).first()
    assert (row.document_type, row.pii_redactions) == ("LOSS_RUN", 1)


def test_token_budget_edges(spark):
    available = (2000 - 1524) * 4
    df = spark.createDataFrame([(0, "x" * available), (1, "a" * available + "b")], "i int, text string")
    rows = G.enforce_token_budget(df, 2000).orderBy("i").collect()
    assert [r.was_truncated for r in rows] == [False, True]
    assert rows[1].text.startswith("a" * int(available * 0.7) + "\n\n[...") and rows[1].text.endswith("ab")
    with pytest.raises(ValueError):
        G.enforce_token_budget(df, 1524)


def test_redaction_order(spark):
    texts = ["card 4111 1111 1111 1111", "ssn 123-45-6789", "id 021000021", "key " + "a1" * 18, "café123-45-6789", "bearer  tok.en=="]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.text for r in G.redact_pii(df).orderBy("i").collect()]
    assert got == ["card [CARD-REDACTED]", "ssn [SSN-REDACTED]", "id [ROUTING-REDACTED]", "key [SECRET-REDACTED]",
                   "café123-45-6789", "Bearer [TOKEN-REDACTED]"]


def test_csv_documents(spark):
    rows = [("a", "x,y\n1,\n\n2,3,4\n5\n".encode()), ("b", b"h;k\ncaf\xe9;2\n"), ("c", b"")]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: r for r in S.csv_documents(df).collect()}
    assert got["a"].raw == [["x", "y"], ["1", None], ["5", None]]
    assert (got["b"].encoding, got["b"].delimiter, got["b"].raw) == ("latin-1", ";", [["h", "k"], ["café", "2"]])
    assert got["c"].raw == []
    cut = {r.path: r for r in S.csv_documents(df, max_rows=1).collect()}
    assert cut["a"].truncated and len(cut["a"].raw) == 3 and not cut["b"].truncated
    assert [tuple(r) for r in S.csv_rejects(S.csv_documents(df)).collect()] == [("a", 4, ["2", "3", "4"])]


def test_csv_header_names(spark):
    df = spark.createDataFrame([("d", b"a,a,b\n1,2,3\n"), ("e", b"a,,b\n1,2,3\n"), ("f", b"a,a.1,a,a\n1,2,3,4\n")], "path string, content binary")
    got = {r.path: (r.headers, r.rows) for r in I.to_table(S.csv_documents(df)).collect()}
    assert got["d"] == (["a", "a.1", "b"], [["1", "2", "3"]])
    assert got["e"] == (["a", "Unnamed: 1", "b"], [["1", "2", "3"]])
    assert got["f"] == (["a", "a.1", "a.2", "a.3"], [["1", "2", "3", "4"]])


def test_mime_rejection(spark):
    rows = [(1, "a.pdf", "application/pdf"), (2, "b.pdf", "application/x-msdownload"), (3, "c.pdf", None)]
    df = spark.createDataFrame([(i, 1, i, n, 10, m) for i, n, m in rows], "upload_id long, submission_id long, uploaded_at long, filename string, size_bytes long, mime_type string")
    assert {r.upload_id: r.reject_reason for r in I.admit(df).collect()} == {1: None, 2: "type not allowed", 3: "type not allowed"}
