"""Numbering and neighbours inside groups of any size.

A window over one key runs in one task. That is fine for ordinary groups and
hopeless for a key that owns a third of the table, so these helpers first ask
which keys are hot (from a sample of the keys) and split the hot groups into
ranges of the order columns: rows are numbered inside each range and shifted
by the counts of the ranges before it. The numbers are the same either way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from bindery.session import shared_dir

HOT_ROWS = 2_000_000
RANGES = 64


def _hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """Keys with about ``hot_rows`` rows or more, or None.

    Read off a sample that holds some thousand rows of any such key, so only
    key columns are scanned and next to nothing is shuffled. A key that is
    missed or named wrongly costs time, never rows.
    """
    fraction = min(1.0, 1000 / hot_rows)
    seen = max(1, int(hot_rows * fraction / 2)) if fraction < 1 else hot_rows
    sample = df.select(*keys) if fraction == 1 else df.select(*keys).sample(fraction=fraction, seed=7)
    hot = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > seen).select(*keys)
    # a small table of its own: Spark sees its size and broadcasts it only if that is small; one task
    # for all of it would hold the buffers of every partition at once
    path = shared_dir(df.sparkSession, "hot-keys")
    hot.write.parquet(path)
    found = df.sparkSession.read.schema(hot.schema).parquet(path)
    return None if found.isEmpty() else found


def _same_key(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"d.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys])


def _split_points(df: DataFrame, keys: list[str], order: list[str], ranges: int) -> list:
    """Some order tuples that cut the rows into similar ranges; any choice is correct.

    Every n-th of a sample of some thousand tuples, so about ``ranges`` of them
    reach the driver.
    """
    total = df.count()
    wanted = ranges * 200
    sample = df.select(*keys, *order).sample(fraction=min(1.0, wanted / max(total, 1)), seed=7)
    picked = sample.select(F.struct(*keys, *order).alias("p")).agg(F.array_sort(F.collect_list("p")).alias("ps")) \
        .select(F.explode(F.expr(
            f"filter(ps, (x, i) -> i > 0 and i % cast(greatest(1, floor(size(ps) / {ranges})) as int) = 0)")).alias("p"))
    return [r.p for r in picked.collect()]


def _range_of(df: DataFrame, keys: list[str], order: list[str], ranges: int) -> Column:
    """Number of split points at or below the row's (keys, order) tuple."""
    points = _split_points(df, keys, order, ranges)
    if not points:
        return F.lit(0)
    me = F.struct(*keys, *order)
    fields = df.select(*keys, *order).schema.fields
    # a literal array keeps the lookup inside the projection, without a join
    cuts = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(p, fields)]) for p in points])
    return F.size(F.filter(cuts, lambda c: c <= me))


def number_within(df: DataFrame, keys: list[str], order: list[str], out: str, last: str | None = None,
                  hot_rows: int = HOT_ROWS, ranges: int = RANGES) -> DataFrame:
    """``row_number()`` over ``keys`` by ``order`` (ascending, a total order) as column ``out``.

    ``last`` names a flag column for the last row of each group.
    """
    plain = Window.partitionBy(*keys).orderBy(*order)
    columns = {out: F.row_number().over(plain)}
    if last:
        columns[last] = F.lead(F.lit(True)).over(plain).isNull()
    hot = _hot_keys(df, keys, hot_rows)
    if hot is None:
        return df.withColumns(columns)
    d, h = df.alias("d"), hot.alias("h")
    cold = d.join(h, _same_key(keys), "left_anti").withColumns(columns)
    busy = d.join(h, _same_key(keys), "left_semi")
    busy = busy.withColumn("_range", _range_of(busy, keys, order, ranges))
    counts = busy.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per hot key and range
    shift = counts.select(*keys, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
                          F.sum("_rows").over(group).alias("_total"))
    inside = busy.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    on = _same_key(keys) & (F.col("d._range") == F.col("h._range"))
    number = F.col("d._rn") + F.col("h._before")
    flags = [(number == F.col("h._total")).alias(last)] if last else []
    numbered = inside.alias("d").join(shift.alias("h"), on).select(
        *[F.col(f"d.{c}") for c in df.columns], number.cast("int").alias(out), *flags)
    return cold.unionByName(numbered)


def next_within(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                hot_rows: int = HOT_ROWS, ranges: int = RANGES) -> DataFrame:
    """``lead(value)`` over ``keys`` by ``order`` as column ``out``."""
    plain = Window.partitionBy(*keys).orderBy(*order)
    hot = _hot_keys(df, keys, hot_rows)
    if hot is None:
        return df.withColumn(out, F.lead(value).over(plain))
    d, h = df.alias("d"), hot.alias("h")
    cold = d.join(h, _same_key(keys), "left_anti").withColumn(out, F.lead(value).over(plain))
    busy = d.join(h, _same_key(keys), "left_semi")
    busy = number_within(busy, keys, order, "_rn", hot_rows=hot_rows, ranges=ranges)
    # (keys, number) is unique, so this join cannot be skewed
    follower = busy.select(*keys, (F.col("_rn") - 1).alias("_rn"), F.col(value).alias(out))
    on = _same_key(keys) & (F.col("d._rn") == F.col("h._rn"))
    linked = busy.alias("d").join(follower.alias("h"), on, "left").select(
        *[F.col(f"d.{c}") for c in df.columns], F.col(f"h.{out}"))
    return cold.unionByName(linked)
