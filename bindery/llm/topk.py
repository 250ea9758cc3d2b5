"""Exact top-k inner products: tiles of queries and shards, joined top lists in a tree.

Vectors become integers, so every score is exact. Shards of ``SHARD`` vectors
and blocks of ``BLOCK`` queries are matrices in a row each. Shards lie in slots
of about ``SLOT_BYTES``, and a block is dealt once to every slot. Every block meets
every shard once, as one matrix product that leaves ``k`` candidates a query;
lists of one block are merged inside the slot, then ``FAN`` at a time until one is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from bindery.llm.common import measured_broadcasts, written

SHARD = 4096
BLOCK = 512
FAN = 16
SLOT_BYTES = 32_000_000  # of shards that a join holds beside a block
SLOTS_A_CORE = 8  # at least, while there are as many shards
_FULL = 2**63 - 1


def _usable(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def _matrices(df: DataFrame, id_col: str, vector: str, scale: int, rows: int, dims: int) -> DataFrame:
    """Rows (ids, m, n, wide): the vectors of a task, ``rows`` at a time, as bytes of 32-bit integers, or of floats where a component needs more."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []

        def made() -> pd.DataFrame:
            m = np.zeros((len(ids), dims))
            for i, v in enumerate(vectors):
                m[i, :len(v)] = v
            wide = bool((np.abs(m) >= 2**31).any())
            out = pd.DataFrame({"ids": [np.array(ids, np.int64).tobytes()], "m": [(m if wide else m.astype(np.int32)).tobytes()], "n": [len(ids)], "wide": [wide]})
            ids.clear()
            vectors.clear()
            return out

        for batch in batches:
            for i, v in zip(batch[id_col], batch[vector]):
                ids.append(int(i))
                vectors.append(np.floor(np.asarray(v, np.float64) * scale))
                if len(ids) == rows:
                    yield made()
        if ids:
            yield made()

    return df.select(id_col, vector).mapInPandas(run, "ids binary, m binary, n int, wide boolean")


def _best(k: int, scores: np.ndarray, ids: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best columns of each row by (score down, id up) among those that are ``there``."""
    out_s, out_i, out_t = np.zeros((len(scores), k), np.int64), np.zeros((len(scores), k), np.int64), np.zeros((len(scores), k), bool)
    for r, (s, i, t) in enumerate(zip(scores, ids, there)):
        s, i = s[t], i[t]
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            near = s >= edge
            s, i = s[near], i[near]
        order = np.lexsort((i, -s.astype(object)) if len(s) and s.min() == -_FULL - 1 else (i, -s))[:k]
        out_s[r, :len(order)], out_i[r, :len(order)], out_t[r, :len(order)] = s[order], i[order], True
    return out_s, out_i, out_t


def _product(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer products: in floats, which are fast, where every sum stays below 2^53.

    Larger ones in 64-bit integers; what might not fit there is summed in integers
    of any size, row by row, and a sum beyond 64 bits becomes the nearest that fits.
    """
    size_q, size_m = (np.abs(x).max(axis=1, initial=0).astype(np.float64) for x in (q, m))
    bound = float(size_q.max(initial=0)) * float(size_m.max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    fits = np.multiply.outer(size_q, size_m) * q.shape[1] < 2**62
    small_q, small_m = size_q < 2**62, size_m < 2**62
    out = np.where(small_q[:, None], q, 0).astype(np.int64) @ np.where(small_m[:, None], m, 0).astype(np.int64).T
    ints = {id(x): {} for x in (q, m)}

    def row(x: np.ndarray, i: int) -> list[int]:
        known = ints[id(x)]
        if i not in known:
            known[i] = [int(v) for v in x[i]]
        return known[i]

    for i, j in zip(*np.nonzero(~fits)):
        out[i, j] = max(-_FULL - 1, min(_FULL, sum(a * b for a, b in zip(row(q, i), row(m, j)))))
    return out


def _matrix(data: bytes, rows: int, dims: int, wide: bool) -> np.ndarray:
    return np.frombuffer(data, np.float64 if wide else np.int32).reshape(rows, dims)


@measured_broadcasts
def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per query its ``k`` best rows: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but those of the query's own id; components are floor(scale * x). Ties
    go to the smaller id. Vectors that are null or hold a null or non-finite
    component, and rows with a null id, take no part. Vectors of
    several lengths are compared as if filled up with zeros; an empty vector
    scores 0. A repeated row is a candidate once per row; a repeated query id
    is answered for its first vector in array order. An empty table gives no
    rows. Other columns are not read. A score beyond 64 bits is given as the
    nearest that fits.
    """
    good = vectors.select(id_col, vector).filter(F.col(id_col).isNotNull() & _usable(vector))
    dims = good.agg(F.max(F.size(vector))).first()[0] or 1
    shards = written(_matrices(good, id_col, vector, scale, SHARD, dims).withColumn("shard", F.monotonically_increasing_id()), "shards")
    asked = good.filter(F.col(id_col) % every == 0).groupBy(id_col).agg(F.min(vector).alias(vector))
    blocks = written(_matrices(asked, id_col, vector, scale, BLOCK, dims).withColumn("block", F.monotonically_increasing_id()), "query-blocks")

    # every block goes once to every slot, and a shard lies in one slot
    n_shards, size = shards.count(), SHARD * dims * 8
    slots = max(1, min(n_shards, max(SLOTS_A_CORE * vectors.sparkSession.sparkContext.defaultParallelism, -(-n_shards * size // SLOT_BYTES))))
    tiles = blocks.withColumnsRenamed({"ids": "qids", "m": "q", "n": "nq", "wide": "wide_q"}) \
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))) \
        .join(shards.withColumn("slot", F.pmod(F.xxhash64("shard"), F.lit(slots)).cast("int")), "slot")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One list for each run of tiles of a block and slot."""
        held = None  # block, slot, qids and the best so far

        def made() -> pd.DataFrame:
            block, slot, qids, *best = held
            return pd.DataFrame({"block": [block], "qids": [qids], "place": [slot], **{c: [x.tobytes()] for c, x in zip("sit", best)}})

        for batch in batches:
            for row in batch.itertuples(index=False):
                q, m = _matrix(row.q, row.nq, dims, row.wide_q), _matrix(row.m, row.n, dims, row.wide)
                own, ids = np.frombuffer(row.qids, np.int64), np.frombuffer(row.ids, np.int64)
                s = _product(q, m)
                best = _best(k, s, np.broadcast_to(ids, s.shape), ids[None, :] != own[:, None])
                if held and held[:2] == (row.block, row.slot):
                    best = _best(k, *(np.concatenate(both, axis=1) for both in zip(held[3:], best)))
                elif held:
                    yield made()
                held = row.block, row.slot, row.qids, *best
        if held:
            yield made()

    lists = "block long, qids binary, place long, s binary, i binary, t binary"
    found = written(tiles.mapInPandas(score, lists), "top-lists")

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        s = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, k) for x in frame["s"]], axis=1)
        i = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, k) for x in frame["i"]], axis=1)
        t = np.concatenate([np.frombuffer(x, bool).reshape(-1, k) for x in frame["t"]], axis=1)
        s, i, t = _best(k, s, i, t)
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "qids": [frame["qids"].iloc[0]], "place": [frame["parent"].iloc[0]],
                             "s": [s.tobytes()], "i": [i.tobytes()], "t": [t.tobytes()]})

    merged = n_shards < 2  # a slot may still have several lists of a block
    while slots > 1 or not merged:
        slots, merged = -(-slots // FAN), True
        found = found.withColumn("parent", F.pmod(F.xxhash64("place"), F.lit(slots)))
        found = found.groupBy("block", "parent").applyInPandas(merge, lists)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = np.frombuffer(row.i, np.int64).reshape(-1, k)
                q, r = np.nonzero(np.frombuffer(row.t, bool).reshape(-1, k))
                yield pd.DataFrame({"query_id": np.frombuffer(row.qids, np.int64)[q], "rank": r.astype(np.int32) + 1,
                                    "vec_id": ids[q, r], "score": np.frombuffer(row.s, np.int64).reshape(-1, k)[q, r]})

    return found.mapInPandas(spread, "query_id long, rank int, vec_id long, score long")

