"""Numbers of rows in an order, and any page of a listing, without one task that has them all.

Rows are sorted over range partitions; a row's number is its place in its range
plus the counts of the ranges before, of which there are as many as partitions.
A page therefore lies in known ranges, and only these are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from bindery.session import shared_dir

_PLACE_BITS = 33  # of a row in its partition, in what monotonically_increasing_id gives


def _sorted_ranges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with _range and _place as a table split by range, (_range, first, rows) of each range)."""
    placed = rows.withColumn("_at", F.monotonically_increasing_id()) \
        .withColumns({"_range": F.shiftright("_at", _PLACE_BITS).cast("int"), "_place": F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)}).drop("_at")
    path = shared_dir(rows.sparkSession, "ranges")
    placed.write.partitionBy("_range").parquet(path)
    stored = rows.sparkSession.read.schema(placed.schema).parquet(path)
    counts = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    # a row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return stored, counts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n")


def numbered(rows: DataFrame, out: str = "place") -> DataFrame:
    """Rows with their number from 1 in the order in which they come, as after ``orderBy``."""
    stored, ranges = _sorted_ranges(rows)
    return stored.join(F.broadcast(ranges.select("_range", "first")), "_range").withColumn(
        out, F.col("first") + F.col("_place") + 1).select(*rows.columns, out)


@dataclass
class Listing:
    """A sorted listing whose pages are found by counting: the table, and (range, first row, rows) of its ranges."""
    table: DataFrame
    ranges: list[tuple[int, int, int]]
    columns: list[str]

    @property
    def total(self) -> int:
        return sum(n for _, _, n in self.ranges)

    def page(self, page: int = 1, page_size: int = 50) -> DataFrame:
        """Rows of one page with their envelope: total, page, page_size, pages; none beyond the last page.

        Rows come in order; only the ranges that the page lies in are read.
        """
        if page < 1 or page_size < 1:
            raise ValueError("pages and their sizes count from 1")
        start, total = (page - 1) * page_size, self.total
        wanted = F.lit(False)
        for number, first, n in self.ranges:
            low, high = max(start, first), min(start + page_size, first + n)
            if low < high:
                wanted = wanted | ((F.col("_range") == number) & F.col("_place").between(low - first, high - first - 1))
        return self.table.filter(wanted).orderBy("_range", "_place").select(*self.columns).withColumns({
            "total": F.lit(total).cast("long"), "page": F.lit(page), "page_size": F.lit(page_size),
            "pages": F.lit(max(1, -(-total // page_size))).cast("long")})


def listing(items: DataFrame, order: list[Column]) -> Listing:
    """Sorts ``items`` once, for any number of pages. ``order`` should leave no ties, or pages may differ between listings."""
    placed = items.repartitionByRange(*order).sortWithinPartitions(*order)
    stored, ranges = _sorted_ranges(placed)
    # as many rows as there are ranges
    return Listing(stored, [tuple(r) for r in ranges.orderBy("_range").collect()], items.columns)
