"""Vector expressions and block-wise similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from bindery.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision, inside the JVM."""
    products = F.zip_with(col(a).cast("array<double>"), col(b).cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def normalise(v: Column | str) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(col(v).cast("array<double>"), lambda x: x / norm)).otherwise(col(v).cast("array<double>"))


def encode(df: DataFrame, text: str, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
           out: str = "embedding", batch_size: int = 32) -> DataFrame:
    """Unit vectors of ``text`` from a caller-supplied encoder.

    ``make_encoder()`` runs once per Python worker task and returns a function
    from a list of texts to a 2-D array.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            rows: list[np.ndarray] = []
            for i in range(0, len(texts), batch_size):
                m = np.asarray(encoder(texts.iloc[i:i + batch_size].tolist()), dtype="float64")
                norms = np.linalg.norm(m, axis=1, keepdims=True)
                rows.extend((m / np.where(norms > 0, norms, 1.0)).astype("float32"))
            yield pd.Series(rows, index=texts.index, dtype=object)

    return df.withColumn(out, vectors(F.col(text)))


# --- many queries against many vectors --------------------------------------
ROWS_AT_ONCE = 256                 # score matrices stay around 20 MB
SLICES = 16                        # parts into which the chunk side of each query block is dealt


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) rows -> one row per Arrow batch holding the batch as a matrix."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids, vectors = batch.column(0), batch.column(1)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("float32")
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([flat.tobytes()], pa.binary()),
             pa.array([len(flat) // batch.num_rows], pa.int32())], names=["ids", "matrix", "dim"])


def best_of_blocks(k: int, floor: float, digits: int, q_type: pa.DataType, c_type: pa.DataType):
    """Rows (ids, matrix, dim, q_ids, q_matrix, q_dim) -> the ``k`` best (query_id, chunk_id, score) of each pair of matrices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_row = {c: batch.column(batch.schema.get_field_index(c)) for c in ("ids", "matrix", "dim", "q_ids", "q_matrix", "q_dim")}
            for i in range(batch.num_rows):  # matrices stay in the batch, the lists of one row are made at a time
                row = {c: v[i] for c, v in at_row.items()}
                queries, vectors = (np.frombuffer(row[m].as_buffer(), dtype="float32").reshape(-1, row[d].as_py()) for m, d in (("q_matrix", "q_dim"), ("matrix", "dim")))
                row = {c: row[c].as_py() for c in ("ids", "q_ids")}
                # ties go to the smaller id: sort the block by id, then cut a stable order at k
                ids = np.empty(len(row["ids"]), object)
                ids[:] = row["ids"]
                order = np.argsort(np.asarray(row["ids"]), kind="stable")
                ids, vectors = ids[order], vectors[order].astype("float64")
                for at in range(0, len(queries), ROWS_AT_ONCE):
                    scores = np.round(queries[at:at + ROWS_AT_ONCE].astype("float64") @ vectors.T, digits)
                    ranked = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    top = np.take_along_axis(scores, ranked, axis=1)
                    q_at, c_at = np.nonzero(top >= floor)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["q_ids"][at + j] for j in q_at], q_type), pa.array(ids[ranked[q_at, c_at]].tolist(), c_type),
                         pa.array(top[q_at, c_at], pa.float64())], names=["query_id", "chunk_id", "score"])
    return run


def block_top_k(queries: DataFrame, chunks: DataFrame, k: int, floor: float,
                queries_per_block: int = 2048, digits: int = 7) -> DataFrame:
    """The k best (query_id, chunk_id, score) candidates per query and chunk block.

    ``queries``: (query_id, vector); ``chunks``: (chunk_id, vector), ids of any
    type that has an order. Every query is scored against every chunk: chunks are
    packed batch by batch where they lie, queries into blocks of bounded size;
    every chunk block meets every query block as one row, and a matrix product
    leaves k rows per query. The chunk blocks of a query block are dealt into
    ``SLICES`` keys, so the blocks shuffle over many tasks however few queries
    there are. Scores are rounded to float32 resolution so that equal vectors tie.
    """
    count = queries.count()
    n_blocks = max(1, -(-count // queries_per_block))
    q = queries.select(F.col(queries.columns[0]).alias("id"), F.col(queries.columns[1]).alias("v"),
                       F.pmod(F.xxhash64(queries.columns[0]), F.lit(n_blocks)).cast("int").alias("block"))
    # about queries_per_block vectors each, whatever the number of queries
    packed_q = q.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("rows")).select(
        "block", F.col("rows.id").alias("q_ids"), F.col("rows.v").alias("vs"))
    packed_q = packed_q.select("block", "q_ids", matrix_of("vs").alias("q_matrix"), F.size(F.element_at("vs", 1)).alias("q_dim")) \
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    q_type, c_type = queries.schema[0].dataType, chunks.schema[0].dataType
    packed = T.StructType([T.StructField("ids", T.ArrayType(c_type)), T.StructField("matrix", T.BinaryType()), T.StructField("dim", T.IntegerType())])
    packed_c = chunks.select(F.col(chunks.columns[0]).alias("id"), F.col(chunks.columns[1]).alias("v")).mapInArrow(_pack, packed) \
        .withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(SLICES)).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = packed_c.join(packed_q, ["block", "slice"]).select("ids", "matrix", "dim", "q_ids", "q_matrix", "q_dim")
    found = T.StructType([T.StructField("query_id", q_type), T.StructField("chunk_id", c_type), T.StructField("score", T.DoubleType())])
    return pairs.mapInArrow(best_of_blocks(k, floor, digits, to_arrow_type(q_type), to_arrow_type(c_type)), found)


@F.arrow_udf(T.BinaryType())
def matrix_of(vectors: pa.Array) -> pa.Array:
    """The vectors of each row behind each other as 4-byte floats; a batch is not copied vector by vector."""
    inner = vectors.flatten()
    dims = pa.compute.list_value_length(inner).to_numpy(zero_copy_only=False)
    sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if len(dims) and (inner.null_count or dims.min() != dims.max()):
        raise ValueError("all vectors must have one length")
    ends = 4 * np.append(0, np.cumsum(dims, dtype=np.int64))[np.append(0, np.cumsum(sizes, dtype=np.int64))]
    flat = np.ascontiguousarray(inner.flatten().to_numpy(zero_copy_only=False).astype("float32", copy=False))
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
