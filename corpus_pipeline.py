"""A corpus pipeline of five stages; each takes and returns a table of documents, the last returns packed pieces.

All stages read ``COLUMNS``; other columns of the input end with the first stage.
Texts are read whole, of any length. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindery.llm import langid, minhash, mixing, packing, secrets
from bindery.llm.common import broadcast_if_small, written
from bindery.llm.queries import TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BATCH = 1000  # rows of texts or shingle sets that pass to Python at a time, which bounds what tasks hold of them
SURE = 0.5  # least share of the letters that must be in one language


def _bounded(spark: SparkSession) -> None:
    """This job's rows are whole texts and sets: fewer of them than Spark's default go to Python in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those without a main language; a missing language is filled in.

    A null or empty text has no letters and goes. Ties between languages go to the
    first in alphabetical order. Rows with a null id or source, and repeated rows,
    are judged by their text like any other.
    """
    _bounded(spark)
    found = langid.identify(docs, langid.learn(docs), carry=True)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE)) \
        .withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near-duplicates (five-word shingles, Jaccard of 0.8), that with the smallest id.

    Different texts of one id are documents of their own, each judged by its own
    text. Of rows with equal id and text one stays, that with the smallest other columns.
    """
    _bounded(spark)
    same = (F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text"))
    rows = docs.withColumns({"_a": F.xxhash64(*same), "_b": F.xxhash64(F.lit(7), *same)})
    names = written(rows.groupBy("doc_id", "_a", "_b").agg(F.count(F.lit(1)).alias("n")), "document-keys")
    repeated = written(names.filter("n > 1").select("_a", "_b"), "repeated-rows")
    if not repeated.isEmpty():
        few = broadcast_if_small(repeated)
        one = rows.join(few, ["_a", "_b"], "left_semi").groupBy("_a", "_b").agg(F.min(F.struct(*COLUMNS)).alias("d"))
        rows = rows.join(few, ["_a", "_b"], "left_anti").select(*COLUMNS, "_a", "_b").union(written(one.select("d.*", "_a", "_b"), "repeats"))
    named = names.filter("doc_id is not null")
    if named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        rows = rows.withColumn("_name", F.col("doc_id"))
    else:  # a number for each id and text, in the order of ids
        numbered = named.orderBy("doc_id", "_a", "_b").select("_a", "_b", F.monotonically_increasing_id().alias("_name"))
        rows = rows.join(broadcast_if_small(written(numbered, "document-names")), ["_a", "_b"], "left")
    found = minhash.near_duplicates(rows, id_col="_name", percent=80)
    gone = written(found.filter("not kept").select("_name"), "near-duplicates")
    return rows.join(broadcast_if_small(gone), "_name", "left_anti").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every confirmed secret in the text by a marker.

    Every row stays, null ids, languages and sources included; a null text stays
    null; repeated rows get equal texts. ``n_chars`` is counted again.
    """
    return secrets.redact(docs, secrets.train(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents into the order of the mix: later stages meet the sources in their target shares.

    Every row stays. Null sources are a source; null ids and repeated rows are rows
    like any other, in any order among equals.
    """
    return mixing.mixed(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences, in the order of the mix: files that are read again come in any order.

    A null text is one end id; a null id stays null on its pieces; repeated rows are
    packed once each.
    """
    _bounded(spark)
    return packing.pack(mixing.mixed(docs), TOKENIZER)


STAGES = [("language ID", languages), ("MinHash near-dedup", near_duplicates), ("secret scans", secret_scans),
          ("mixing sources to target weights", mixed_sources), ("packing", packed)]

#: Learned models and tokenizers have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not packed:
            docs = written(docs, name.replace(" ", "-"))
    return docs
