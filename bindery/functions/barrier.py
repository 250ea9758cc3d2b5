"""Keeping costly expressions evaluated once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, **named: Column) -> DataFrame:
    """Adds columns that later filters and projections cannot re-inline.

    Predicate push-down substitutes a column's definition into the filter, so
    a filter on a classified type would repeat a hundred regular expressions.
    The one-element ``explode`` is a narrow operator predicates stay above.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in named.items()]))
    kept = [c for c in df.columns if c not in named]
    return df.select(*kept, F.explode(packed).alias("_once")).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in named])
