"""What the operators share: tables in the shared folder, size-checked broadcasts, small hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from bindery.session import shared_dir

#: Rows of a few bytes each up to which one side of a join may be broadcast (some 100 MB in memory).
BROADCAST_ROWS = 4_000_000


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow rows, already written) with a broadcast hint if it has few rows; else a shuffle join is left to Spark."""
    return F.broadcast(df) if df.count() <= limit else df


def measured_broadcasts(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Joins that ``operator`` (a table first) runs are broadcast by hint or by a size measured behind a shuffle, never by an estimate.

    Spark takes an exploded table for as many rows as there were before, and
    columns of bytes for a hundred bytes each, so a table of any size may be
    estimated below the limit. The limit itself goes on for measured sizes.
    """
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        conf = df.sparkSession.conf
        limit, adaptive = conf.get(static), conf.get(measured, None)
        conf.set(measured, adaptive or limit)
        conf.set(static, "-1")
        try:
            return operator(df, *args, **options)
        finally:
            conf.set(static, limit)
            conf.set(measured, adaptive) if adaptive else conf.unset(measured)
    return run


_LOCAL: dict = {}


def once(key, make):
    """``make()``, kept in this worker process until another key is asked for: workers are used again by other operators.

    All that an operator remembers between tasks hangs on this one entry, so a
    change of operator gives its memory back to the machine.
    """
    if key not in _LOCAL:
        _LOCAL.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not this C library
            pass
        _LOCAL[key] = make()
    return _LOCAL[key]


def by_size(batches: Iterator[pa.RecordBatch], text: str, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts have about ``size`` bytes, one text at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        part = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
        for s, e in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(int(s), int(e - s))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole key groups from batches that come sorted by ``keys``; a group is never cut.

    A frame holds all complete groups of a batch, so many small groups are handled at once.
    """
    rest = None
    for batch in batches:
        if batch.empty:
            continue
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        last = batch.iloc[-1]
        open_ = np.ones(len(batch), bool)
        for k in keys:
            open_ &= (batch[k] == last[k]).to_numpy()
        rest = batch[open_]
        if not open_.all():
            yield batch[~open_].reset_index(drop=True)
    if rest is not None:
        yield rest.reset_index(drop=True)
