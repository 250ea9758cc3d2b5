"""A clustered index of vectors and exact top-k search that skips clusters.

Vectors lie in clusters; a cluster has a centroid and a radius, the largest
distance of a member from it. No member scores more against a query than
query . centroid + |query| * radius, so a cluster whose bound lies below a query's
k-th best score so far cannot add to its results and is never read for it. The
answer is the one that comparing everything would give.

Centroids come from k-means over a bounded sample, which decides how much can be
skipped and nothing else; every vector is assigned and indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from bindery import fixed
from bindery.functions.vectors import best_of_blocks, matrix_of
from bindery.session import shared_dir

SAMPLE = 20_000  # vectors from which centroids are found
CLUSTERS = 256  # at most
ROUNDS = 8  # of k-means
BLOCK = 1024  # vectors in a stored matrix
SLICE_BLOCKS = 8  # matrices of a cluster that queries meet in one task
QUERIES = 512  # about so many queries meet a slice together
SLACK = 1e-6  # scores are rounded to seven digits


@dataclass
class VectorIndex:
    """Matrices by cluster; cluster, centroid, radius, n, slices of each cluster; what else is known of each chunk."""
    blocks: DataFrame
    clusters: DataFrame
    chunks: DataFrame


def _centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """k-means from the first ``k`` distinct vectors; empty clusters keep their centroid."""
    centroids = np.unique(sample, axis=0)
    centroids = centroids[np.linspace(0, len(centroids) - 1, min(k, len(centroids))).astype(int)]
    for _ in range(ROUNDS):
        own = _nearest(sample, centroids)[0]
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, distance from it) of each vector."""
    near = ((centroids**2).sum(axis=1)[None, :] - 2 * vectors @ centroids.T).argmin(axis=1)
    return near, np.linalg.norm(vectors - centroids[near], axis=1)


def build(chunks: DataFrame, id_col: str = "chunk_id", vector: str = "embedding", clusters: int | None = None) -> VectorIndex:
    """An index of all ``chunks`` with a vector, written to the shared folder; all vectors have one length.

    ``clusters``: how many, by default the square root of the sample's size. Rows
    without a vector are not indexed. An empty table gives an empty index.
    """
    spark, kind = chunks.sparkSession, chunks.schema[id_col].dataType
    present = chunks.filter(F.col(vector).isNotNull())
    sample = present.select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64(id_col)).limit(SAMPLE).toArrow()["v"]
    found = np.array(sample.to_pylist(), np.float64) if len(sample) else np.zeros((1, 1))
    centroids = _centroids(found, clusters or min(CLUSTERS, max(1, int(len(found) ** 0.5))))
    shared = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("struct<cluster: int, distance: double>")
    def assign(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cluster": pd.Series([], dtype="int32"), "distance": pd.Series([], dtype="float64")})
        own, distance = _nearest(np.stack([np.asarray(v, np.float64) for v in vectors]), shared.value)
        return pd.DataFrame({"cluster": own.astype("int32"), "distance": distance})

    placed = present.select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("v")).withColumn("_at", assign("v")).select("id", "v", "_at.*")
    path = shared_dir(spark, "assigned")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    sizes = placed.groupBy("cluster").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n"))
    known = {r.cluster: r for r in sizes.collect()}  # at most CLUSTERS rows
    rows = [(i, c.tolist(), known[i].radius, known[i].n, max(1, -(-known[i].n // (BLOCK * SLICE_BLOCKS)))) for i, c in enumerate(centroids) if i in known]
    table = spark.createDataFrame(rows, "cluster int, centroid array<double>, radius double, n long, slices int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        vectors: list[np.ndarray] = []
        held = None

        def made() -> pa.RecordBatch:
            m = np.concatenate(vectors)
            out = pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int32()), pa.array([ids], pa.list_(to_arrow_type(kind))),
                                              pa.array([m.tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32())], names=["cluster", "slice", "ids", "matrix", "dim"])
            ids.clear()
            vectors.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "slice")], axis=1)
            rows = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(batch.num_rows, -1)
            cuts = np.flatnonzero(np.append(True, (place[1:] != place[:-1]).any(axis=1))).tolist() + [batch.num_rows]
            for at, end in zip(cuts, cuts[1:]):
                if ids and held != tuple(place[at].tolist()):
                    yield made()
                held = tuple(place[at].tolist())
                while at < end:
                    if len(ids) == BLOCK:
                        yield made()
                    some = min(end - at, BLOCK - len(ids))
                    ids.extend(batch.column("id").slice(at, some).to_pylist())
                    vectors.append(rows[at:at + some].copy())
                    at += some
        if ids:
            yield made()

    dealt = placed.join(F.broadcast(table.select("cluster", "slices")), "cluster").withColumn("slice", F.pmod(F.xxhash64("id"), "slices").cast("int"))
    shape = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("slice", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)),
                          T.StructField("matrix", T.BinaryType()), T.StructField("dim", T.IntegerType())])
    packed = dealt.select("cluster", "slice", "id", "v").repartition("cluster", "slice").sortWithinPartitions("cluster", "slice").mapInArrow(pack, shape)
    path = shared_dir(spark, "vector-blocks")
    packed.write.partitionBy("cluster").parquet(path)
    return VectorIndex(spark.read.schema(packed.schema).parquet(path), table, present.drop(vector))


def _asked(queries: DataFrame, index: VectorIndex, k: int, floor: float) -> DataFrame:
    """Queries with the clusters that can reach ``floor``, nearest first, their bounds, and how many hold the first ``k`` candidates."""
    known = index.clusters.orderBy("cluster").collect()  # at most CLUSTERS rows
    centroids = np.array([r.centroid for r in known], np.float64)
    names, radius, size = (np.array([r[c] for r in known]) for c in ("cluster", "radius", "n"))

    @F.pandas_udf("struct<clusters: array<int>, bounds: array<double>, first: int>")
    def probe(vectors: pd.Series) -> pd.DataFrame:
        rows = []
        for v in vectors:
            q = np.asarray(v, np.float64)
            near = centroids @ q
            bound = near + np.linalg.norm(q) * radius
            order = np.lexsort((names, -near))
            order = order[bound[order] + SLACK >= floor]
            first = int(np.searchsorted(np.cumsum(size[order]), k)) + 1
            rows.append((names[order].tolist(), bound[order].tolist(), min(first, len(order))))
        return pd.DataFrame(rows, columns=["clusters", "bounds", "first"])

    return queries.withColumn("_p", probe("v")).select("id", "v", "_p.*")


def _scored(pairs: DataFrame, index: VectorIndex, k: int, floor: float, digits: int, q_type: T.DataType, c_type: T.DataType) -> DataFrame:
    """(query_id, chunk_id, score): the ``k`` best of each stored matrix for every (id, v, cluster)."""
    counts = pairs.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
    dealt = pairs.join(F.broadcast(counts), "cluster").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))  # a row a cluster
    packed = dealt.groupBy("cluster", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows")).select(
        "cluster", F.col("rows.id").alias("q_ids"), F.col("rows.v").alias("vs"))
    packed = packed.select("cluster", "q_ids", matrix_of("vs").alias("q_matrix"), F.size(F.element_at("vs", 1)).alias("q_dim")) \
        .join(F.broadcast(index.clusters.select("cluster", "slices")), "cluster").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    met = index.blocks.join(packed, ["cluster", "slice"]).select("ids", "matrix", "dim", "q_ids", "q_matrix", "q_dim")
    shape = T.StructType([T.StructField("query_id", q_type), T.StructField("chunk_id", c_type), T.StructField("score", T.DoubleType())])
    return met.mapInArrow(best_of_blocks(k, floor, digits, to_arrow_type(q_type), to_arrow_type(c_type)), shape)


def probes(index: VectorIndex, queries: DataFrame, k: int, floor: float, digits: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first candidates, remaining pairs (id, v, cluster), all queries): the second holds only clusters that can still change a result."""
    spark = queries.sparkSession
    asked = _asked(queries.select(F.col(queries.columns[0]).alias("id"), F.col(queries.columns[1]).alias("v")), index, k, floor)
    path = shared_dir(spark, "probes")
    asked.write.parquet(path)
    asked = spark.read.schema(asked.schema).parquet(path)
    q_type, c_type = asked.schema["id"].dataType, index.blocks.schema["ids"].dataType.elementType
    first = _scored(asked.select("id", "v", F.explode(F.slice("clusters", F.lit(1), F.col("first"))).alias("cluster")), index, k, floor, digits, q_type, c_type)
    path = shared_dir(spark, "first-candidates")
    first.write.parquet(path)
    first = spark.read.schema(first.schema).parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    kth = first.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    rest = asked.join(kth, "id", "left").select("id", "v", "kth", F.posexplode(F.arrays_zip("clusters", "bounds")).alias("i", "c"), "first") \
        .filter((F.col("i") >= F.col("first")) & (F.col("c.bounds") + SLACK >= F.coalesce("kth", F.lit(floor)))).select("id", "v", F.col("c.clusters").alias("cluster"))
    return first, rest, asked


def search(index: VectorIndex, queries: DataFrame, top_k: int = fixed.TOP_K, min_similarity: float = fixed.MIN_SIMILARITY) -> DataFrame:
    """(query_id, rank, similarity, chunk columns): the exact ``top_k`` of every query, ties to the smaller chunk id.

    ``queries``: (query_id, vector). Scores below ``min_similarity`` are dropped.
    """
    if index.clusters.isEmpty():
        shape = T.StructType([*index.chunks.schema.fields, T.StructField("query_id", queries.schema[0].dataType), T.StructField("rank", T.IntegerType()), T.StructField("similarity", T.DoubleType())])
        return queries.sparkSession.createDataFrame([], shape)
    first, rest, _ = probes(index, queries, top_k, min_similarity)
    more = _scored(rest, index, top_k, min_similarity, 7, first.schema["query_id"].dataType, first.schema["chunk_id"].dataType)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    ranked = first.unionByName(more).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)
    return ranked.join(index.chunks, "chunk_id").withColumn("similarity", F.round("score", 4)).drop("score")
