from pyspark.sql import functions as F

from bindery.operators import history as H


def test_percentile_of_stages_is_exact(spark):
    log = spark.range(40_000).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("S"), (F.col("id") % 3).cast("string"))).alias("stage"), F.when(F.col("id") % 5 == 0, "STARTED").otherwise("SUCCESS").alias("status"),
        (F.col("id") * 7919 % 1_000_003).alias("duration_ms"))
    rows = log.collect()
    for found in H.stage_metrics(log).collect():
        timed = sorted(r.duration_ms for r in rows if r.stage == found.stage and r.status == "SUCCESS")
        assert found.p95_ms == timed[-(-95 * len(timed) // 100) - 1]
    few = spark.createDataFrame([("A", "SUCCESS", 5), ("A", "FAILURE", None), ("B", "STARTED", 7)], "stage string, status string, duration_ms long")
    assert {r.stage: r.p95_ms for r in H.stage_metrics(few).collect()} == {"A": 5, "B": None}
