"""Near-duplicate documents by HyperMinHash.

Each distinct set of word shingles is summarised by ``K`` buckets; a bucket
keeps the leading-zero count and ``MANTISSA`` further bits of its smallest hash.
Bands of the compressed registers propose candidates, the Jaccard estimate
(corrected for registers that agree by chance) discards the hopeless ones, and
full sets decide.

No group is ever expanded into its pairs. Documents with equal sets form a
class first. Each member is then compared with one pivot, of the smallest
members of its band buckets the one it meets most often; next, where buckets
still span several components, with one of their best-linked members. What is
still apart after that is compared block by block inside tasks, by matrix
products over the shingles that a block's members share, and only links that
join two components leave a task. So all components come out whole, whatever
the size of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from bindery.llm.common import broadcast_if_small, grouped, measured_broadcasts, mix, once, written
from bindery.llm.components import components

K = 128  # buckets
BANDS = 32  # of K / BANDS registers: at a Jaccard of 0.8 a pair shares no band once in 2e7
MANTISSA = 10  # bits kept beside the leading-zero count
BLOCK = 1024  # members of a bucket compared with as many others in one go
SLICE = 4096  # shared shingles that a matrix product takes at a time
SIGMAS = 5  # an estimate this far below the threshold ends a candidate

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, K, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased and nothing else."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words make one shingle, no words none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    known = once("shingles", dict)
    if len(known) > 150_000:
        known.clear()
    hashes = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        hashes[i] = h
    size = min(size, len(words))
    n = len(words) - size + 1
    acc = np.full(n, size, np.uint64)
    for j in range(size):
        acc = mix(acc ^ hashes[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(mix(acc))


def registers(hashes: np.ndarray) -> np.ndarray:
    """``K`` registers of 16 bits: leading zeros of the bucket's smallest hash, then mantissa bits."""
    low = np.full(K, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 512):
        low = np.minimum(low, (np.multiply.outer(hashes[at:at + 512], _A) + _B).min(axis=0))
    mantissa, exponent = np.frexp((low >> np.uint64(11)).astype(np.float64))
    bits = ((mantissa - 0.5) * 2 * 2**MANTISSA).astype(np.int64)
    return (((53 - exponent).astype(np.int64) << MANTISSA) | np.maximum(bits, 0)).astype(np.uint16)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard from the share of equal registers, less those that agree by chance.

    Two unrelated smallest hashes with rates n and m fall into one register with
    probability 2^-MANTISSA * n m / ((n + m)^2 * 2 ln 2).
    """
    n, m = np.asarray(n, float), np.asarray(m, float)
    chance = 2.0**-MANTISSA * n * m / ((n + m) ** 2 * 2 * math.log(2))
    return (equal / K - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    t = percent / 100
    return t - SIGMAS * math.sqrt(t * (1 - t) / K)


def _sign(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["_id"], batch["_text"]):
                s = shingle_set(text, size)
                rows.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), registers(s).tobytes()) if len(s) else (doc, 0, None, None))
            out = pd.DataFrame(rows, columns=["id", "n", "set_hash", "sig"])
            out["id"] = out["id"].astype("Int64")
            yield out
    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch["_text"]]
            yield pd.DataFrame({"id": batch["_id"], "n": [len(x) for x in sets], "hashes": [x.tobytes() for x in sets]})
    return run


def _promising(pairs: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """``pairs(a, b)`` whose estimate reaches ``floor``."""
    @F.pandas_udf("boolean")
    def passes(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        a = np.frombuffer(b"".join(x), np.uint16).reshape(-1, K)
        b = np.frombuffer(b"".join(y), np.uint16).reshape(-1, K)
        return pd.Series(estimate((a == b).sum(axis=1), n, m) >= floor)

    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").filter(passes("sa", "sb", "na", "nb")).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int, purpose: str) -> DataFrame:
    """``pairs(a, b)`` that reach the threshold on their full sets, written."""
    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        found = []
        for p, q in zip(x, y):
            s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = np.sort(np.concatenate([s, t]))
            common = int((both[1:] == both[:-1]).sum())
            found.append(100 * common >= percent * (len(s) + len(t) - common))
        return pd.Series(found, dtype=bool)

    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), f"{purpose}-ids")
    needed = texts.join(broadcast_if_small(ids), "_id", "left_semi")
    sets = written(needed.mapInPandas(_sets(size), "id long, n long, hashes binary"), f"{purpose}-sets")
    first = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    second = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    return written(pairs.join(first, "a").join(second, "b").filter(linked("ha", "hb")).select("a", "b").distinct(), f"{purpose}-links")


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left with the right sets."""
    both = np.union1d(left, right)
    rows = np.repeat(np.arange(len(both)), [len(sets[i]) for i in both])
    _, column, count = np.unique(np.concatenate([sets[i] for i in both]), return_inverse=True, return_counts=True)
    often = count > 1  # others are in no intersection
    names = np.cumsum(often) - 1
    rows, column = rows[often[column]], names[column[often[column]]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    l, r = np.searchsorted(both, left), np.searchsorted(both, right)
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(often.sum()), SLICE):
        s, e = np.searchsorted(column, [at, at + SLICE])
        m = np.zeros((len(both), SLICE), np.float32)
        m[rows[s:e], column[s:e] - at] = 1
        out += m[l] @ m[r].T
    return out


def _blocks(percent: int):
    """Links on full sets between two blocks of a bucket, as many as join components."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in grouped(batches, ["key", "low", "high"]):
            ids, comp, n = (frame[c].to_numpy() for c in ("id", "component", "n"))
            block, low, high = (frame[c].to_numpy() for c in ("block", "low", "high"))
            sets = [np.frombuffer(x, np.uint64) for x in frame["hashes"]]
            names = frame[["key", "low", "high"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1), True])
            found: set[tuple[int, int]] = set()
            for s, e in zip(starts[:-1], starts[1:]):
                left = np.arange(s, e)[block[s:e] == low[s]]
                right = left if low[s] == high[s] else np.arange(s, e)[block[s:e] == high[s]]
                if not len(left) or not len(right) or len(np.unique(comp[s:e])) < 2:
                    continue
                common = _shared(sets, left, right)
                x, y = np.nonzero((100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)) & (comp[left][:, None] != comp[right][None, :]))
                parent: dict[int, int] = {}

                def find(c: int) -> int:
                    while parent.setdefault(c, c) != c:
                        parent[c] = c = parent[parent[c]]
                    return c

                for i, j in zip(left[x], right[y]):
                    p, q = find(int(comp[i])), find(int(comp[j]))
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        found.add((int(max(ids[i], ids[j])), int(min(ids[i], ids[j]))))
            if found:
                yield pd.DataFrame(sorted(found), columns=["a", "b"])
    return run


def _one_each(pairs: DataFrame) -> DataFrame:
    """Of the rows (a, b), one for each bucket that they share, the b that a meets most often; the smallest of equals."""
    met = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("a").agg(F.max(F.struct("n", F.negative("b").alias("minus"))).alias("m")).select("a", F.negative("m.minus").alias("b"))


@measured_broadcasts
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, size: int = 5) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= percent * |union| of their
    shingle sets; ``component_id`` is the smallest id reachable over links and
    ``kept`` marks it. Null or blank texts have the empty set and no links.
    Repeated rows share a set and so a component. A row without an id is linked
    with nothing, has no component and is kept. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    signed = written(texts.mapInPandas(_sign(size), "id long, n long, set_hash binary, sig binary"), "signatures")
    known = signed.filter("id is not null and n > 0")
    counted = known.groupBy("set_hash").agg(F.min(F.struct("id", "n", "sig")).alias("c"), F.count(F.lit(1)).alias("copies"))
    classes = written(counted.select("set_hash", "copies", "c.id", "c.n", "c.sig"), "classes")
    width = 2 * K // BANDS
    bands = classes.select("id", F.posexplode(F.array(*[F.substring("sig", 1 + i * width, width) for i in range(BANDS)])).alias("band", "part")) \
        .select("id", F.xxhash64("band", "part").alias("key"))
    floor = least_estimate(percent)

    # first: every member against one of the smallest members of its buckets
    pivots = bands.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("top")).filter("b != top").select("key", "b")
    stars = written(_one_each(bands.withColumnRenamed("id", "a").join(pivots, "key").filter("a != b").select("a", "b")), "star-pairs")
    stars = written(_promising(stars, classes, floor), "star-candidates")
    links = _confirmed(stars, texts, percent, size, "stars")
    groups = written(components(links), "star-components")

    # then, where a bucket spans components: against the member with most links
    def mixed(groups: DataFrame) -> DataFrame:
        """Band rows of buckets with two components or more, with component; other buckets are settled."""
        labelled = classes.select("id").join(groups.withColumnRenamed("node", "id"), "id", "left") \
            .select("id", F.coalesce("component", "id").alias("component"))
        labelled = written(labelled, "labels")
        rows = bands.join(labelled, "id")
        split = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members")) \
            .filter("x != y").select("key", "members")
        return written(rows.join(split, "key"), "mixed-buckets")

    rows = mixed(groups)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    ranked = rows.join(degree, "id", "left").select("key", "id", "component", F.coalesce("degree", F.lit(0)).alias("degree"))
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", F.negative("id").alias("minus"), "component")).alias("h")) \
        .select("key", F.negative("h.minus").alias("b"), F.col("h.component").alias("hub"))
    spokes = written(_one_each(rows.join(hubs, "key").filter("component != hub").select(F.col("id").alias("a"), "b")), "hub-pairs")
    spokes = written(_promising(spokes, classes, floor), "hub-candidates")
    links = links.union(_confirmed(spokes, texts, percent, size, "hubs"))
    groups = written(components(links), "hub-components")

    # last: everything that is still apart, block against block
    rows = mixed(groups).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    ids = written(rows.select(F.col("id").alias("_id")).distinct(), "rest-ids")
    sets = written(texts.join(broadcast_if_small(ids), "_id", "left_semi").mapInPandas(_sets(size), "id long, n long, hashes binary"), "rest-sets")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "id", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    rows = rows.join(sets, "id").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    rest = written(rows.mapInPandas(_blocks(percent), "a long, b long").distinct(), "rest-links")
    groups = components(links.union(rest))

    # a class of one that is linked with nothing needs no entry
    settled = classes.select("set_hash", "copies", "id").join(groups.withColumnRenamed("node", "id"), "id", "left") \
        .filter("copies > 1 or component is not null").select("set_hash", F.coalesce("component", "id").alias("component"))
    settled = written(settled, "class-components")
    return signed.join(settled, "set_hash", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))
