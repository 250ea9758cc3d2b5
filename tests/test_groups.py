"""Groups of any size: hot-key paths give the rows of the plain paths."""

import random

from pyspark.sql import Window, functions as F

from bindery.operators import ranking, relational as R, risk


def skewed(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(25), i) for i in range(n)]
    return spark.createDataFrame(rows, "key string, at int, id long")


def plain(df, out, fn):
    return df.withColumn(out, fn(Window.partitionBy("key").orderBy("at", "id")))


def as_set(df):
    return sorted(tuple(r) for r in df.collect())


def test_number_within_hot_key(spark):
    df = skewed(spark)
    want = as_set(plain(df, "n", lambda w: F.row_number().over(w)))
    assert as_set(ranking.number_within(df, ["key"], ["at", "id"], "n", hot_rows=50, ranges=8)) == want
    assert as_set(ranking.number_within(df, ["key"], ["at", "id"], "n")) == want


def test_last_flag(spark):
    df = skewed(spark)
    want = as_set(plain(plain(df, "n", lambda w: F.row_number().over(w)), "last", lambda w: F.lead("id").over(w).isNull()))
    assert as_set(ranking.number_within(df, ["key"], ["at", "id"], "n", last="last", hot_rows=50, ranges=8)) == want
    assert as_set(ranking.number_within(df, ["key"], ["at", "id"], "n", last="last")) == want


def test_next_within_hot_key(spark):
    df = skewed(spark)
    want = as_set(plain(df, "nxt", lambda w: F.lead("id").over(w)).fillna(-1))
    assert as_set(ranking.next_within(df, ["key"], ["at", "id"], "id", "nxt", hot_rows=50, ranges=8).fillna(-1)) == want
    assert as_set(ranking.next_within(df, ["key"], ["at", "id"], "id", "nxt").fillna(-1)) == want


def test_hot_null_key(spark):
    df = spark.createDataFrame([(None, 1, i) for i in range(100)] + [("a", 1, 200)], "key string, at int, id long")
    got = ranking.number_within(df, ["key"], ["at", "id"], "n", hot_rows=20, ranges=4)
    assert sorted(r.n for r in got.filter("key is null").collect()) == list(range(1, 101))


def test_one_shape_for_any_number_of_documents(spark):
    docs = spark.createDataFrame([(1, i, f"d{i}", "OTHER") for i in range(1500)] + [(2, 9000, "x", "OTHER")],
                                 "submission_id long, document_id long, original_filename string, document_type string")
    subs = spark.createDataFrame([(1, 7, 7), (2, 7, None), (3, 7, 7)], "submission_id long, created_by long, assigned_to long")
    users = spark.createDataFrame([(7, "Jo")], "user_id long, full_name string")
    rows = R.with_documents(subs, docs, users).collect()
    assert sorted((r.ordinal, r.document_id) for r in rows if r.submission_id == 1) == [(i + 1, i) for i in range(1500)]
    assert [(r.ordinal, r.document_id) for r in rows if r.submission_id == 3] == [(None, None)]
    assert {r.assigned_name for r in rows} == {"Jo", None}


def test_breakdown_keeps_every_factor(spark):
    subs = spark.createDataFrame([(1,), (2,)], "submission_id long")
    factors = spark.createDataFrame([(1, f"f{i:04d}", 1) for i in range(1200)], "submission_id long, name string, delta long")
    rows = risk.score_breakdown(risk.risk_scores(subs, factors), factors).collect()
    assert sorted((r.ordinal, r.name) for r in rows if r.submission_id == 1) == [(i + 1, f"f{i:04d}") for i in range(1200)]
    assert [r.ordinal for r in rows if r.submission_id == 2] == [None] and '"final_score":100' in rows[0].score_breakdown + rows[-1].score_breakdown


def test_thresholds_must_increase():
    import pytest
    with pytest.raises(ValueError):
        risk.check_thresholds(70, 69, 70)
