"""Composed classification flows."""

from pyspark.sql import DataFrame, functions as F

from bindery.operators import classify


def classified_documents(docs: DataFrame) -> DataFrame:
    """Documents -> counts and mean confidence by type and decision.

    One narrow stage (sample, features, scores, rank) and one small shuffle.
    """
    return (docs.transform(classify.classify_by_rules).transform(classify.decide)
            .groupBy("document_type", "decision")
            .agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.avg("confidence"), 4).alias("mean_confidence")))
