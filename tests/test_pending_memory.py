"""Memory of one task: numbering and pending documents do not hold what grows with the table."""

from pyspark.sql import DataFrame, functions as F

from bindery.operators import ingest, ranking


def test_hot_keys_are_not_gathered_by_one_task(spark, monkeypatch):
    """Before, one task held the aggregation buffers of all partitions, some 67 MB each."""
    merged, plain = [], DataFrame.coalesce
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "coalesce", lambda self, n: merged.append(n) or plain(self, n))
    df = spark.range(2000).select((F.col("id") % 400 % 37).alias("k"), "id").repartition(16, "k")
    numbered = ranking.number_within(df, ["k"], ["id"], "n", last="is_last", hot_rows=100, ranges=4)
    rows = sorted((r.k, r.id, r.n, bool(r.is_last)) for r in numbered.collect())
    want = []
    for k in range(37):
        ids = [i for i in range(2000) if i % 400 % 37 == k]
        want += [(k, i, at + 1, at + 1 == len(ids)) for at, i in enumerate(ids)]
    assert rows == want and not merged


def test_long_errors_are_not_sorted(spark):
    docs = spark.range(50).select(F.col("id").alias("document_id"), (F.col("id") % 5 != 4).alias("is_current_version"),
                                  F.when(F.col("id") % 2 == 0, "PENDING").otherwise("COMPLETED").alias("processing_status"))
    results = spark.range(60).select(F.col("id").alias("document_id"), (F.col("id") % 4 == 0).alias("needs_ocr"), F.col("id").alias("page_count"),
                                     F.when(F.col("id") % 3 == 0, F.repeat(F.lit("x"), 5000)).alias("error"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        done = ingest.process_pending(docs, results)
        assert "Sort " not in done._jdf.queryExecution().executedPlan().toString()
        rows = {r.document_id: r for r in done.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert set(rows) == {i for i in range(0, 50, 2) if i % 5 != 4}
    for i, r in rows.items():
        assert r.processing_status == ("FAILED" if i % 3 == 0 else "OCR_PROCESSING" if i % 4 == 0 else "COMPLETED")
        assert r.failure_reason == ("x" * 5000 if i % 3 == 0 else None)
