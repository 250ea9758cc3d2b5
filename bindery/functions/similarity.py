"""Sequence similarity, the one scalar Spark has no expression for."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F, types as T


SHORT = 400  # characters of a pair that a worker remembers: at most 20 000 such pairs


@lru_cache(maxsize=20_000)
def _known(a: str, b: str) -> float:
    """Fields of many submissions hold the same few texts, so most pairs have been seen before."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def ratio(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    return _known(a, b) if len(a) + len(b) <= SHORT else difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``difflib`` ratio of two text columns, Arrow batches."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio_at_least(least: float):
    """Like ``sequence_ratio`` but null below ``least``; cheap upper bounds decide most pairs."""
    def bounded(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        m = difflib.SequenceMatcher(None, x, y)
        if m.real_quick_ratio() < least or m.quick_ratio() < least:
            return None
        found = m.ratio()
        return found if found >= least else None

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bounded(x, y) for x, y in zip(a, b)], dtype="float64")
    # not "deterministic" to the optimizer: a filter on the result must not run it a second time
    return run.asNondeterministic()
