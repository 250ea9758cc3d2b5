"""Divergence audit of the sources of each language over exact, run-length coded term profiles.

A language keeps the terms that enough of its documents hold. A group (language,
source) and the language itself give each kept term a smoothed share in whole
billionths, so every result is an exact integer. A share depends on the term's
count alone; therefore the vocabulary is put into an order in which equal counts
lie together and cut into blocks of ``BLOCK`` places, and a group's column of a
block is stored as runs (first place, share). Two groups are compared by
intersecting the boundaries of their runs: the distance of the two shares times
the length of each common piece.

Counting shrinks a task's texts to its distinct terms before anything moves.
Vocabularies are ordered by a range-partitioned sort, columns have at most
``BLOCK`` runs, and sources meet each other in tiles of about ``TILE``, so no
task holds a whole vocabulary or all sources of a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from bindery.llm.common import broadcast_if_small, grouped, once, written

BLOCK = 8192  # places of the vocabulary order that a column covers
TILE = 64  # sources that meet as many others in one go
LEADERS = 4  # largest sources of a language whose counts order its vocabulary
FLUSH = 400_000  # distinct (group, term) a task holds before it passes them on
SCALE = 1_000_000_000  # fixed value: shares are in billionths
PRIOR = 5  # fixed value: added to every count
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and code points from U+0080 on, in UTF-8; only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once("divergence", dict)
    occurrences: dict[tuple, Counter] = {}
    documents: dict[tuple, Counter] = {}
    seen: set[tuple] = set()

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in occurrences.items():
            names, n, d = list(terms), np.fromiter(terms.values(), np.int64, len(terms)), documents[lang, source]
            d = np.fromiter(map(d.__getitem__, names), np.int64, len(names))
            for at in range(0, len(names), 50_000):
                part = names[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(part), pa.string()) for x in (lang, source)] +
                                                 [pa.array(part, pa.binary()), pa.array(n[at:at + 50_000]), pa.array(d[at:at + 50_000])],
                                                 names=["lang", "source", "term", "n", "d"])
        occurrences.clear()
        documents.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            key = lang, source
            terms = terms_of(text)
            if terms:
                occurrences.setdefault(key, Counter()).update(terms)
                documents.setdefault(key, Counter()).update(set(terms))
            seen.add(key)
        if sum(map(len, occurrences.values())) > FLUSH:
            yield from flush()
    yield from flush()
    if seen:  # a group without terms is a group too: a row without a term
        langs, sources = zip(*seen)
        zero = pa.array(np.zeros(len(seen), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.nulls(len(seen), pa.binary()), zero, zero],
                                         names=["lang", "source", "term", "n", "d"])


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)), exact."""
    return F.expr(f"1 + cast({SCALE} as decimal(12,0)) * cast({n} + {PRIOR} as decimal(19,0)) div cast({total} + {PRIOR} * {kept} as decimal(19,0))")


def _columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Run-length codes of each group's column; the row of place -1 has the block's size and the share of a count of 0."""
    for frame in grouped(batches, ["lang", "block", "source"]):
        place, p, size = frame["place"].to_numpy(), frame["p"].to_numpy(), frame["size"].to_numpy()
        heads = np.flatnonzero(place < 0)
        starts, shares = [], []
        for s, e in zip(heads, [*heads[1:], len(frame)]):
            column = np.full(size[s], p[s], np.int64)
            column[place[s + 1:e]] = p[s + 1:e]
            first = np.flatnonzero(np.r_[True, column[1:] != column[:-1]]) if len(column) else np.empty(0, np.int64)
            starts.append(first.astype(np.int32).tobytes())
            shares.append(column[first].tobytes())
        out = frame.loc[heads, ["lang", "block", "source", "tile", "tiles", "size"]]
        yield out.assign(starts=starts, shares=shares)


def distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> int:
    """Sum of |p - q| over ``size`` places from two columns of runs (first places, shares)."""
    if not size:
        return 0
    cuts = np.union1d(a[0], b[0])
    p, q = (c[1][np.searchsorted(c[0], cuts, side="right") - 1] for c in (a, b))
    return int((np.abs(p - q) * np.diff(np.r_[cuts, size])).sum())


def _tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in grouped(batches, ["lang", "block", "low", "high"]):
        for (lang, _, low, high), part in frame.groupby(["lang", "block", "low", "high"], sort=False):
            runs = [(np.frombuffer(s, np.int32), np.frombuffer(p, np.int64)) for s, p in zip(part["starts"], part["shares"])]
            names, tile, size = list(part["source"]), part["tile"].to_numpy(), int(part["size"].iloc[0])
            left = np.flatnonzero(tile == low)
            right = np.flatnonzero(tile == high)
            rows = [(lang, names[i], names[j], distance(runs[i], runs[j], size)) for i in left for j in right if low != high or i < j]
            if rows:
                yield pd.DataFrame(rows, columns=["lang", "source", "item", "value"])


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 30, top: int = 50) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every occurring group (lang, source).

    Part ``pair``: every other source of the language with the sum of |p - q| over
    the language's kept terms, 0 without any. Part ``term``: the terms that the
    group holds and uses more than its language does, by p - q, the first ``top``.
    Ranks go by value, largest first, then by the item's UTF-8 bytes.

    Null texts, languages and sources are read as ''. Repeated rows count each
    time. Texts are read whole. An empty table gives no rows; a group without
    terms has pairs only. Other columns are not read.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    rows = read.mapInArrow(_counted, "lang string, source string, term binary, n long, d long")
    counts = written(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "term-counts")
    terms = counts.filter("term is not null")
    names = counts.filter("term is null").select("lang", "source")

    # kept terms, equal counts side by side: by the counts of the largest sources, then by the language's
    order = Window.partitionBy("lang").orderBy(F.desc("size"), "source")
    sizes = terms.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    leaders = written(sizes.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= LEADERS).select("lang", "source", "slot"), "leaders")
    slots = [f"c{i}" for i in range(1, LEADERS + 1)]
    lead = terms.join(broadcast_if_small(leaders), ["lang", "source"], "left").groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("d").alias("docs"),
        *[F.coalesce(F.max(F.when(F.col("slot") == i, F.col("n"))), F.lit(0)).alias(c) for i, c in enumerate(slots, 1)])
    kept = written(lead.filter(F.col("docs") >= min_docs), "kept-terms")
    keys = ["lang", *reversed(slots), "total", "term"]
    placed = kept.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    vocabulary = written(placed.select("lang", "term", "total", F.expr(f"at div {BLOCK}").alias("block"), (F.col("at") % BLOCK).cast("int").alias("at")), "vocabulary")
    # a block that begins in one language and ends in another: places count from the language's first
    blocks = written(vocabulary.groupBy("lang", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).cast("int").alias("size")), "blocks")

    kept = written(terms.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "total", "block", "at"), "kept-counts")
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("total").alias("lang_sum"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_sum"))
    tiles = names.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    groups = written(names.join(of_group, ["lang", "source"], "left").join(langs, "lang", "left").join(tiles, "lang").na.fill(0, ["group_sum", "n_kept", "lang_sum"])
                     .withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int")), "groups")
    few = broadcast_if_small(groups)

    # a column for each group and block; a language without terms has one block without places
    base = groups.join(blocks, "lang", "left").select(
        "lang", F.coalesce("block", F.lit(-1)).alias("block"), "source", F.lit(-1).alias("place"),
        F.when(F.col("n_kept") > 0, share("0L", "group_sum", "n_kept")).otherwise(F.lit(0)).cast("long").alias("p"),
        F.coalesce("size", F.lit(0)).alias("size"), "tile", "tiles")
    cells = kept.join(few, ["lang", "source"]).join(broadcast_if_small(blocks), ["lang", "block"]).select(
        "lang", "block", "source", (F.col("at") - F.col("first")).alias("place"), share("n", "group_sum", "n_kept").cast("long").alias("p"), "size", "tile", "tiles")
    cells = base.unionByName(cells).repartition("lang", "block", "source").sortWithinPartitions("lang", "block", "source", "place")
    columns = written(cells.mapInPandas(_columns, "lang string, block long, source string, tile int, tiles int, size int, starts binary, shares binary"), "columns")
    met = columns.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))) \
        .withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other", "tiles") \
        .repartition("lang", "block", "low", "high").sortWithinPartitions("lang", "block", "low", "high", "source")
    found = met.mapInPandas(_tiles, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    found = written(found, "pairs")
    pairs = found.union(found.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    used = kept.join(few, ["lang", "source"]).withColumn("value", share("n", "group_sum", "n_kept") - share("total", "lang_sum", "n_kept")).filter("value > 0")
    used = used.select("lang", "source", F.col("term").cast("string").alias("item"), F.col("value").cast("long"))
    ranked = [(pairs, "pair", None), (used, "term", top)]
    pair, term = (df.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit if limit else F.lit(True))
                  .select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int")) for df, part, limit in ranked)
    return pair.unionByName(term)
