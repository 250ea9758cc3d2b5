import numpy as np
from pyspark.sql import functions as F

from bindery.operators import vector_index as VI


def tables(spark, vectors, queries):
    c = spark.createDataFrame([(f"c{i:04d}", 7, None if v is None else [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)],
                              "chunk_id string, page_number int, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(queries)], "query_id long, query_embedding array<float>")
    return c, q


def brute(vectors, queries, k, floor):
    out = set()
    for i, q in enumerate(queries):
        scores = [(-round(float(np.float32(q).astype(float) @ np.float32(v).astype(float)), 7), f"c{j:04d}") for j, v in enumerate(vectors) if v is not None]
        out |= {(i, r, c, round(-s, 4)) for r, (s, c) in enumerate(sorted(scores)[:k], 1) if -s >= floor}
    return out


def clustered(rng, groups, each, dim):
    centers = rng.normal(size=(groups, dim))
    v = np.repeat(centers, each, axis=0) + rng.normal(size=(groups * each, dim)) * 0.05
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def rows(found):
    return {(r.query_id, r["rank"], r.chunk_id, r.similarity) for r in found.collect()}


def test_exact_and_most_clusters_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(VI, "BLOCK", 16)
    monkeypatch.setattr(VI, "SLICE_BLOCKS", 2)
    monkeypatch.setattr(VI, "QUERIES", 3)
    rng = np.random.default_rng(1)
    vectors = list(clustered(rng, 12, 60, 8))
    vectors[100] = vectors[70]  # a tie
    vectors[3] = None
    queries = [vectors[i * 37 + 1] for i in range(18)]
    c, q = tables(spark, vectors, queries)
    index = VI.build(c, clusters=24)
    assert rows(VI.search(index, q, 5, -2.0)) == brute(vectors, queries, 5, -2.0)
    assert rows(VI.search(index, q, 5, 0.3)) == brute(vectors, queries, 5, 0.3)
    first, rest, asked = VI.probes(index, q, 5, -2.0)
    looked = asked.agg(F.sum("first")).first()[0] + rest.count()
    assert looked < 0.3 * index.clusters.count() * len(queries)
    assert VI.search(index, q, 5, 0.3).filter("page_number = 7").count() == len(brute(vectors, queries, 5, 0.3))


def test_vectors_without_clusters_and_few_rows(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(40, 4)) * rng.uniform(0.1, 5, size=(40, 1))  # any lengths
    queries = rng.normal(size=(7, 4))
    c, q = tables(spark, list(vectors), list(queries))
    assert rows(VI.search(VI.build(c), q, 6, -100.0)) == brute(vectors, queries, 6, -100.0)
    few, _ = tables(spark, [vectors[0], vectors[0]], [])
    assert rows(VI.search(VI.build(few), q, 6, -100.0)) == brute([vectors[0], vectors[0]], queries, 6, -100.0)
    assert VI.search(VI.build(c.limit(0)), q, 6).count() == 0
    assert VI.search(VI.build(c), q.limit(0), 6).count() == 0
