"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks. Block j (from 1) of a source of weight w is
released at floor((j - 1) / w) and due at ceil(j / w); in every slot the released
block with the earliest deadline runs. As the weights sum to one, every block
meets its deadline and no source is ever a whole block away from its share.

Weights are whole numbers of ``UNITS``, so a schedule repeats after ``UNITS``
slots and a block's slot is arithmetic. When a source runs out, the others go on
with their weights scaled up, from a new schedule: every document is placed
once. The driver only sees the counts of at most ``MAX_SOURCES`` sources; all
others share one weight.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

UNITS = 1000
MAX_SOURCES = 100
BUCKET_ROWS = 50_000
REST = "(other sources)"


def whole_weights(weights: dict[str, float], units: int = UNITS) -> dict[str, int]:
    """Weights as whole units that sum to ``units``, each at least 1, by largest remainders."""
    total = sum(weights.values())
    spare = units - len(weights)
    exact = {s: spare * w / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:units - sum(out.values())]:
        out[s] += 1
    return out


def one_period(units: dict[str, int]) -> dict[str, list[int]]:
    """Slots of every source's blocks in one period, earliest deadline first."""
    period = sum(units.values())
    release = [(0, -(-period // u), s, 1) for s, u in sorted(units.items())]
    heapq.heapify(release)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in units}
    for t in range(period):
        while release and release[0][0] <= t:
            _, due, s, j = heapq.heappop(release)
            heapq.heappush(ready, (due, s, j))
        _, s, j = heapq.heappop(ready)
        slots[s].append(t)
        u = units[s]
        if j < u:
            heapq.heappush(release, (j * period // u, -(-(j + 1) * period // u), s, j + 1))
    return slots


@dataclass
class Phase:
    """A stretch of slots in which the same sources take part."""
    start: int  # first slot
    length: int
    first: dict[str, int]  # blocks a source has placed before
    slots: dict[str, list[int]]


def phases(blocks: dict[str, int], units: dict[str, int]) -> list[Phase]:
    """The whole schedule: a phase ends with the last block of a source."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done, at, out = dict.fromkeys(left, 0), 0, []
    while left:
        share = whole_weights({s: units[s] for s in left}, sum(units.values()))
        slots, period = one_period(share), sum(share.values())
        ends = {s: (n - 1) // len(slots[s]) * period + slots[s][(n - 1) % len(slots[s])] + 1 for s, n in left.items()}
        length = min(ends.values())
        out.append(Phase(at, length, dict(done), slots))
        for s in list(left):
            whole, part = divmod(length, period)
            ran = whole * len(slots[s]) + sum(t < part for t in slots[s])
            done[s] += ran
            left[s] -= ran
            if not left[s]:
                del left[s]
        at += length
    return out


def _numbered(rows: DataFrame, keys: DataFrame, sizes: dict[str, int], order: list[str]) -> DataFrame:
    """``rows`` (with _src) and _row, the number inside the source from 0, whatever the size of a source.

    A source is dealt by a hash of the id into buckets of about ``BUCKET_ROWS``
    rows; rows are numbered inside their bucket and shifted by the buckets before.
    """
    many = F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, -(-n // BUCKET_ROWS))])
    bucket = F.pmod(F.xxhash64(F.lit(7), *order), F.element_at(many, F.col("_src"))).cast("int")
    counts = keys.withColumn("_bucket", bucket).groupBy("_src", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each source and bucket
    shifts = counts.select("_src", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_src", "_bucket").orderBy(*[F.xxhash64(c) for c in order], *order)
    numbered = rows.withColumn("_bucket", bucket).withColumn("_in", F.row_number().over(inside) - 1)
    return numbered.join(shifts, ["_src", "_bucket"]).withColumn("_row", F.col("_in") + F.col("_before")).drop("_in", "_before", "_bucket")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
        block_rows: int = 16, temperature: float = 0.5, carry: bool = False) -> DataFrame:
    """Per row of ``docs``: id, source, mix_source, block, slot, position; with ``carry`` also all columns of ``docs``.

    ``position`` (from 0, without gaps inside a block, increasing with slot)
    orders the mix: block ``slot`` holds up to ``block_rows`` rows of one source.
    ``weights`` maps sources to target weights; without it a source's weight is
    its row count to the power ``temperature``. Sources without a weight, null
    ones included, form one source whose weight is the smallest given; beyond
    ``MAX_SOURCES`` the smaller ones do. Inside a source, rows are ordered by a
    hash of the id, then the id; null ids and repeated rows are rows like any
    other, in any order among equals. Every row is placed exactly once. An empty
    table gives no rows.
    """
    name = F.coalesce(F.col(source_col).cast("string"), F.lit(REST))
    base = docs if carry else docs.select(id_col, source_col)
    # at most MAX_SOURCES + 1 counts
    counts = {r._s: r["count"] for r in docs.groupBy(name.alias("_s")).count().orderBy(F.desc("count"), "_s").limit(MAX_SOURCES).collect()}
    known = {s: w for s, w in (weights or {s: n**temperature for s, n in counts.items()}).items() if s != REST and w > 0}
    if len(known) > MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES} weights")
    target = {**known, REST: min(known.values(), default=1.0)}
    source = F.when(name.isin(*known), name).otherwise(F.lit(REST)) if known else F.lit(REST)
    sizes = {r._src: r.n for r in docs.groupBy(source.alias("_src")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        sizes = {REST: 1}
    rows = _numbered(base.withColumn("_src", source), docs.select(id_col, source.alias("_src")), sizes, [id_col])
    rows = rows.withColumn("_block", F.floor(F.col("_row") / block_rows))
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}
    units = whole_weights({s: target[s] for s in blocks})

    # (source, first block, end, start slot, period, slots): one small row for each source and phase
    plan = []
    schedule = phases(blocks, units)
    for i, p in enumerate(schedule):
        following = schedule[i + 1].first if i + 1 < len(schedule) else blocks
        plan += [(s, p.first[s], following[s], p.start, sum(units.values()), slots) for s, slots in p.slots.items()]
    shape = "_src string, _first long, _end long, _start long, _period long, _slots array<int>"
    table = F.broadcast(docs.sparkSession.createDataFrame(plan, shape))  # at most (MAX_SOURCES + 1)^2 rows
    on = (rows["_src"] == table["_src"]) & (F.col("_block") >= F.col("_first")) & (F.col("_block") < F.col("_end"))
    nth = F.col("_block") - F.col("_first")
    size = F.size("_slots")
    slot = F.col("_start") + F.floor(nth / size) * F.col("_period") + F.get("_slots", F.pmod(nth, size).cast("int"))
    placed = rows.join(table, on).withColumn("_slot", slot.cast("long"))
    extra = [F.col(c).alias(f"_doc_{c}") for c in docs.columns] if carry else []
    return placed.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), rows["_src"].alias("mix_source"), F.col("_block").cast("long").alias("block"),
                         F.col("_slot").alias("slot"), (F.col("_slot") * block_rows + F.pmod(F.col("_row"), F.lit(block_rows))).cast("long").alias("position"), *extra) \
        .withColumnsRenamed({"_id": id_col, "_source": source_col} if not carry else {})


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` itself, in the order of the mix: sorted over all partitions by position. Options as in ``mix``."""
    rows = mix(docs, carry=True, **options)
    return rows.orderBy("position").select(*[F.col(f"_doc_{c}").alias(c) for c in docs.columns])
