import os
import shutil

import pytest
from pyspark.sql import functions as F

from bindery.sources import store

SCHEMA = "submission_id long, document_id long, full_text string, tags array<string>"


def table(rows):
    return sorted((tuple(r) for r in rows.collect()), key=str)


def made(spark, n=60):
    return spark.createDataFrame([(i % 11, i, f"text {i}", [str(i)]) for i in range(n)], SCHEMA)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_two_documents_are_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    store.create(made(spark), path, buckets=8)
    before, rows = files(path), table(store.load(spark, path))
    new = spark.createDataFrame([(3, 3, "again", ["x"]), (3, 3, "again, page 2", None), (4, 400, "new", [])], SCHEMA)
    store.replace(new, path, ["submission_id", "document_id"])
    want = sorted([r for r in rows if r[1] != 3] + [tuple(r) for r in new.collect()], key=str)
    assert table(store.load(spark, path)) == want
    assert table(store.load(spark, path, 3)) == [r for r in want if r[0] == 3]
    after = files(path)
    assert all(after[f] == t for f, t in before.items()) and len({os.path.dirname(f) for f in after if f not in before}) <= 2
    store.replace(new, path, ["submission_id", "document_id"])  # the same again
    assert table(store.load(spark, path)) == want
    assert table(store.load(spark, path, generation=0)) == rows


def test_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    store.create(made(spark), path, buckets=4)
    rows = table(store.load(spark, path))
    broken = made(spark, 9).withColumn("full_text", F.when(F.col("document_id") == 8, F.raise_error(F.lit("lost"))).otherwise("half"))
    with pytest.raises(Exception, match="lost"):
        store.replace(broken, path, ["submission_id", "document_id"])
    assert table(store.load(spark, path)) == rows
    # data of a generation that was never committed, as a stopped driver leaves it
    os.makedirs(f"{path}/data/generation=1/bucket=0", exist_ok=True)
    shutil.copytree(f"{path}/data/generation=0", f"{path}/data/generation=1", dirs_exist_ok=True)
    assert table(store.load(spark, path)) == rows
    store.replace(made(spark, 2).withColumn("full_text", F.lit("whole")), path, ["submission_id", "document_id"])
    got = table(store.load(spark, path))
    assert len(got) == len(rows) and [r[2] for r in got if r[1] < 2] == ["whole", "whole"]


def test_removal_empty_buckets_nulls_and_stale_writer(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store.create(spark.createDataFrame([], SCHEMA), path, buckets=4)
    assert table(store.load(spark, path)) == [] == table(store.load(spark, path, 5))
    rows = spark.createDataFrame([(None, None, "no ids", None), (1, None, "no document", None), (1, 2, "b", None)], SCHEMA)
    store.replace(rows, path, ["submission_id", "document_id"])
    store.replace(rows.filter("submission_id is null"), path, ["submission_id", "document_id"], removed=rows.filter("submission_id = 1"))
    assert table(store.load(spark, path)) == [(None, None, "no ids", None)]
    old = store.manifest(spark, path)
    store.replace(rows, path, ["submission_id", "document_id"])
    monkeypatch.setattr(store, "manifest", lambda *_: old)
    with pytest.raises(store.StaleTableError):
        store.replace(rows, path, ["submission_id", "document_id"])
    monkeypatch.undo()
    assert len(table(store.load(spark, path))) == 3
    with pytest.raises(ValueError):
        store.replace(rows, path, ["document_id"])
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "none"))


def test_vacuum(spark, tmp_path):
    path = str(tmp_path / "t")
    store.create(made(spark), path, buckets=4)
    for i in range(3):
        store.replace(made(spark, 1 + i).withColumn("full_text", F.lit(f"run {i}")), path, ["submission_id", "document_id"])
    rows, before = table(store.load(spark, path)), len(files(path))
    assert store.vacuum(spark, path) > 0
    assert table(store.load(spark, path)) == rows and len(files(path)) < before
    assert store.vacuum(spark, path) == 0
