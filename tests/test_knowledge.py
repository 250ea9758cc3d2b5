import numpy as np
import pytest
from pyspark.sql import functions as F

from bindery.functions.vectors import block_top_k, encode
from bindery.operators import knowledge as K


def brute_chunks(text):
    words = text.split()
    if not words:
        return []
    if len(words) < 20:
        return [text.strip()]
    out, start = [], 0
    while start < len(words):
        part = words[start:start + 400]
        if len(part) < 20:
            out[-1] += " " + " ".join(part)
            break
        out.append(" ".join(part))
        start += 360
    return out


@pytest.mark.parametrize("n", [0, 1, 19, 20, 360, 361, 379, 380, 400, 401, 740, 760, 1500])
def test_chunks(spark, n):
    text = "  " + " ".join(f"w{i}" for i in range(n)) + "\n"
    docs = spark.createDataFrame([(1, text)], "document_id long, text string")
    got = [r.chunk_text for r in K.chunk_texts(docs).orderBy("chunk_index").collect()]
    assert got == brute_chunks(text)


def test_block_top_k_many_blocks(spark):
    rng = np.random.default_rng(1)
    chunks, queries = rng.normal(size=(300, 8)), rng.normal(size=(50, 8))
    chunks /= np.linalg.norm(chunks, axis=1, keepdims=True)
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    chunks[10] = chunks[5]                                     # a tie
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(chunks)], "chunk_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, query_embedding array<double>")
    from pyspark.sql import Window
    found = block_top_k(q, c, 3, 0.2, queries_per_block=7)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    got = sorted((r.query_id, r.rank, r.chunk_id) for r in found.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").collect())
    scores = np.round(queries.astype("float32").astype("float64") @ chunks.astype("float32").astype("float64").T, 7)
    want = []
    for i, s in enumerate(scores):
        order = sorted(range(len(s)), key=lambda j: (-s[j], j))[:3]
        want += [(i, r, j) for r, j in enumerate(order, 1) if s[j] >= 0.2]
    assert got == sorted(want)


def test_more_query_blocks_than_partitions(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 4))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"id-{i:03d}", v.tolist()) for i, v in enumerate(vectors)], "chunk_id string, embedding array<double>").repartition(3)
    got = block_top_k(df, df, 1, -1.0, queries_per_block=3)
    best = {}
    for r in got.collect():
        best[r.query_id] = max(best.get(r.query_id, (-2, "")), (r.score, r.chunk_id))
    assert {q: c for q, (_, c) in best.items()} == {f"id-{i:03d}": f"id-{i:03d}" for i in range(60)}


def test_chunks_do_not_carry_the_text(spark):
    docs = spark.createDataFrame([(1, "w " * 900)], "document_id long, text string")
    plan = K.chunk_texts(docs)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Generate")]
    assert "_words" not in above and "text#" not in above.replace("chunk_text#", "")


def test_encoder_yields_unit_vectors(spark):
    def make():
        return lambda texts: np.array([[len(t), 1.0, 0.0] for t in texts])
    df = spark.createDataFrame([("abc",), ("defgh",)], "t string")
    for row in encode(df, "t", make).collect():
        assert np.linalg.norm(row.embedding) == pytest.approx(1.0, abs=1e-6)


def test_search_limits(spark):
    with pytest.raises(ValueError):
        K.search(spark.createDataFrame([], "chunk_id long, embedding array<float>"), [1.0], top_k=21)


def test_context_is_empty_without_hits(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = spark.createDataFrame([(1, 1, "T", "1.0", "", "body")], "query_id long, rank int, title string, version string, section string, chunk_text string")
    got = {r.query_id: r.context for r in K.context_for(queries, hits).collect()}
    assert got == {1: "[1] T 1.0 — Section Unknown\nbody", 2: ""}
