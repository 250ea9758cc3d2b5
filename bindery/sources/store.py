"""Stored tables of which a few documents can be replaced, in buckets, behind a manifest.

A table is a folder with ``data/generation=g/bucket=b`` files and a ``manifest``
folder. Replacing documents writes only the buckets they lie in, as a new
generation: kept rows of these buckets and the new rows. The manifest's part of
that generation, one small file, names for every bucket the generation that
counts; it is written last, by one rename. A reader takes the newest manifest, so
it sees the table before or after a replacement and never a half of it; what a
failed write left behind is named by no manifest.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKETS = 64
_MANIFEST = "generation long, bucket int, data_generation long, buckets int, columns string"


class StaleTableError(RuntimeError):
    """Another writer has committed since the table was read."""


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def bucket_of(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).json(f"{path}/manifest")


def manifest(spark: SparkSession, path: str, generation: int | None = None) -> list:
    """A row for each bucket of the newest generation, or of an older one; empty without a table.

    Holds as many rows as the table has buckets, a number fixed when it is made.
    """
    if not _exists(spark, f"{path}/manifest"):
        return []
    parts = _history(spark, path)
    wanted = parts.filter(F.col("generation") == generation) if generation is not None else parts.join(
        parts.agg(F.max("generation").alias("generation")), "generation")
    return wanted.orderBy("bucket").collect()


def _schema(rows: list) -> T.StructType:
    return T.StructType.fromJson(json.loads(rows[0].columns))


def _read(spark: SparkSession, path: str, rows: list, buckets: set[int] | None = None) -> DataFrame:
    """Rows of the buckets (all by default) that a manifest names."""
    wanted = [r for r in rows if r.data_generation >= 0 and (buckets is None or r.bucket in buckets)]
    schema = _schema(rows)
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/generation={r.data_generation}/bucket={r.bucket}" for r in wanted])


def load(spark: SparkSession, path: str, bucket_value=None, generation: int | None = None) -> DataFrame:
    """The table as of its newest generation (or an older one); with ``bucket_value`` only the bucket of that value is read."""
    rows = manifest(spark, path, generation)
    if not rows:
        raise FileNotFoundError(f"no table at {path}")
    by = _bucketed_by(rows)
    if bucket_value is None:
        return _read(spark, path, rows)
    kind = _schema(rows)[by].dataType
    value = F.lit(bucket_value).cast(kind)
    bucket = spark.range(1).select(bucket_of(value, rows[0].buckets)).first()[0]
    return _read(spark, path, rows, {bucket}).filter(F.col(by) == value)


def _bucketed_by(rows: list) -> str:
    return next(f.name for f in _schema(rows).fields if f.metadata.get("bucketed"))


def _write(rows: DataFrame, path: str, generation: int, bucket: str, buckets: int) -> None:
    """Files of a generation; the rebalance splits a bucket that is large and joins small ones."""
    (rows.withColumn("bucket", bucket_of(F.col(bucket), buckets)).hint("rebalance", "bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/generation={generation}"))


def _commit(spark: SparkSession, path: str, generation: int, named: dict[int, int], buckets: int, schema: T.StructType) -> None:
    rows = [(generation, b, g, buckets, schema.json()) for b, g in sorted(named.items())]
    target = f"{path}/manifest/part={generation}"
    if _exists(spark, f"{target}/_SUCCESS"):
        raise StaleTableError(f"generation {generation} of {path} is there already")
    # one file: it appears by one rename
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(target)


def _filled(spark: SparkSession, path: str, generation: int, buckets: list[int]) -> set[int]:
    """Buckets of a generation that have rows."""
    return {b for b in buckets if _exists(spark, f"{path}/data/generation={generation}/bucket={b}")}


def create(rows: DataFrame, path: str, bucket: str = "submission_id", buckets: int = BUCKETS) -> None:
    """A new table with all ``rows``, or all rows of a table that is there, as one new generation."""
    spark = rows.sparkSession
    known = manifest(spark, path)
    generation = known[0].generation + 1 if known else 0
    fields = [T.StructField(f.name, f.dataType, True, {"bucketed": True} if f.name == bucket else {}) for f in rows.schema.fields]
    _write(rows, path, generation, bucket, buckets)
    filled = _filled(spark, path, generation, list(range(buckets)))
    _commit(spark, path, generation, {b: generation if b in filled else -1 for b in range(buckets)}, buckets, T.StructType(fields))


def replace(new: DataFrame, path: str, key: list[str], removed: DataFrame | None = None) -> None:
    """Takes the rows of ``new`` for all stored rows with the same ``key``; those named in ``removed`` go.

    ``key`` holds the bucket column, so only the buckets of the new and removed
    keys are read and written. ``new`` is read twice and should be a table or
    cheap. Rows of ``new`` are kept as they come, several of one key included;
    doing the same again gives the same table. Null keys replace null keys.
    Raises ``StaleTableError`` if another writer was first.
    """
    spark = new.sparkSession
    rows = manifest(spark, path)
    if not rows:
        raise FileNotFoundError(f"no table at {path}")
    by, buckets, schema, generation = _bucketed_by(rows), rows[0].buckets, _schema(rows), rows[0].generation + 1
    if by not in key:
        raise ValueError(f"the key must hold {by}, by which the table is bucketed")
    new = new.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])
    keys = new.select(*key) if removed is None else new.select(*key).union(removed.select(*[F.col(k).cast(schema[k].dataType) for k in key]))
    keys = keys.distinct()
    # at most ``buckets`` numbers
    touched = {r[0] for r in keys.select(bucket_of(F.col(by), buckets)).distinct().collect()}
    if not touched:
        return
    stored = _read(spark, path, rows, touched)
    same = reduce(lambda a, b: a & b, (F.col(f"s.{k}").eqNullSafe(F.col(f"k.{k}")) for k in key))
    kept = stored.alias("s").join(keys.alias("k"), same, "left_anti")
    _write(kept.select(*[f.name for f in schema.fields]).union(new), path, generation, by, buckets)
    filled = _filled(spark, path, generation, sorted(touched))
    named = {r.bucket: (generation if r.bucket in filled else -1) if r.bucket in touched else r.data_generation for r in rows}
    _commit(spark, path, generation, named, buckets, schema)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes what only generations before the newest ``keep`` name; returns how many data folders went.

    Readers of an older generation lose it, so this runs when none is left.
    """
    if keep < 1 or not _exists(spark, f"{path}/manifest"):
        return 0
    parts = _history(spark, path)
    newest = parts.agg(F.max("generation")).first()[0]
    if newest is None:
        return 0
    live = {(r.data_generation, r.bucket) for r in parts.filter(F.col("generation") > newest - keep).select("data_generation", "bucket").distinct().collect()}
    # keep * buckets pairs at most above, the folders of the old generations below
    old = parts.filter(F.col("generation") <= newest - keep).select("generation", "data_generation", "bucket").distinct().collect()
    gone = {(r.data_generation, r.bucket) for r in old} - live
    for generation in {r.generation for r in old}:
        _delete(spark, f"{path}/manifest/part={generation}")
    n = 0
    for generation, bucket in gone:
        folder = f"{path}/data/generation={generation}/bucket={bucket}"
        if generation >= 0 and _exists(spark, folder):
            _delete(spark, folder)
            n += 1
    return n
