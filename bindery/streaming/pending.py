"""Newly landed documents, each once: the batch transforms as a stream.

A file source remembers files. A document that lands in two files, in one run or
in two, is told apart by keyed state: the ids and content hashes seen so far,
which the checkpoint keeps with the offsets. The state grows with the documents,
unless ``within`` bounds it; on a large intake it belongs into RocksDB
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bindery.operators import classify, guardrails, ingest
from bindery.sources import store


def stream_documents(spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Landed parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def each_once(documents: DataFrame, key: str = "document_id", content: str = "text", within: str | None = None, event_time: str | None = None) -> DataFrame:
    """One row of every document and content, whichever file and run it comes in; the first that is seen.

    The same document with another content is a new revision and passes. Null
    contents are equal to each other; a null key is a key like any other. With
    ``within`` and ``event_time`` repeats are only looked for that far apart and
    older state is dropped.
    """
    marked = documents.withColumn("_content", F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256)) \
        .withColumn("_empty", F.col(content).isNull())
    seen = [key, "_content", "_empty"]
    if within:
        marked = marked.withWatermark(event_time, within).dropDuplicatesWithinWatermark(seen)
    else:
        marked = marked.dropDuplicates(seen)
    return marked.drop("_content", "_empty")


def process(documents: DataFrame, max_tokens: int) -> DataFrame:
    """Normalise, classify and screen; stateless, so it serves batches and streams alike."""
    classified = (documents.transform(ingest.normalise_text)
                  .transform(classify.classify_by_rules).transform(classify.decide))
    kept = classified.select("document_id", "text", "document_type", "confidence", "decision")
    return guardrails.sanitise_input(kept, max_tokens).select(
        "document_id", "document_type", "confidence", "decision", "injection_pattern", "pii_redactions", "was_truncated",
        F.length("text").alias("n_chars"))


def run_available(processed: DataFrame, out: str, checkpoint: str) -> None:
    """Processes what has landed since the last run and stops.

    The checkpoint remembers the files read and the documents seen (``each_once``),
    so every one is written once even if executors or the driver are lost in between.
    """
    query = (processed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()


def run_into(processed: DataFrame, path: str, checkpoint: str, bucket: str = "document_id", order: str | None = None, buckets: int = store.BUCKETS) -> None:
    """Like ``run_available`` into a stored table with one row a document: its last revision.

    A batch that runs again after a failure replaces the same documents by the same
    rows. Of several revisions in one batch the one with the largest ``order`` (by
    default any) stays. The table is made when it is not there.
    """
    spark = processed.sparkSession
    if not store.manifest(spark, path):
        store.create(spark.createDataFrame([], processed.schema), path, bucket, buckets)

    def put(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            last = batch.groupBy(bucket).agg(F.max_by(F.struct(*batch.columns), order or F.lit(0)).alias("d")).select("d.*")
            store.replace(last, path, [bucket])
        finally:
            batch.unpersist()

    (processed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
