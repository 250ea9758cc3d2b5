import random

import numpy as np

from bindery.llm import topk


def brute(rows, k, every):
    good = [(i, np.floor(np.asarray(v, float) * 1024)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.r_[v, np.zeros(width - len(v))]) for i, v in good]
    out = []
    for q, v in good:
        if q % every == 0:
            best = sorted(((-int(v @ w), i) for i, w in good if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, 1, b"") for i, v in rows], "vec_id long, embedding array<float>, shard int, block int, ids binary").repartition(5)
    return sorted(tuple(r) for r in topk.top_k(df, **options).collect())


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "FAN", 3)
    rng = random.Random(1)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (500, [float("inf")] * 8), (600, [0.5, 0.5]), (None, rows[1][1]), (700, [])]
    assert run(spark, rows, k=10, every=20) == brute(rows, 10, 20)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0, 2.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0])]) == [(0, 1, 2, 1048576), (0, 2, 3, 1048576)]


def test_negative_ids_and_large_components(spark):
    rng = random.Random(3)
    rows = [(i * 7 - 500, [rng.choice([-1, 1]) * 2.0 ** rng.randint(0, 24) for _ in range(6)]) for i in range(150)]
    rows += [(-2**63 + 8, [3e38] * 6), (2**62, [-3e38] * 6), (-1, [1e6] * 6)]

    def exact(v):
        return [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]

    want = []
    for q, v in rows:
        if q % 20 == 0:
            best = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(exact(v), exact(w))))), i) for i, w in rows if i != q)[:10]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = run(spark, rows, k=10, every=20)
    assert got == sorted(want) and any(q < 0 for q, *_ in got)


def test_no_block_is_broadcast_by_an_estimate(spark, monkeypatch):
    """A block goes to every slot: Spark's estimate of the blocks does not count that."""
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "BLOCK", 3)
    plans, lists, written = {}, {}, topk.written

    def watched(df, purpose):
        plans[purpose] = df._jdf.queryExecution().sparkPlan().toString()
        out = written(df, purpose)
        lists[purpose] = out.count()
        return out

    monkeypatch.setattr(topk, "written", watched)
    monkeypatch.setattr(topk, "SLOTS_A_CORE", 0)
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(static)
    rows = [(i, [float(i % 7), float(i % 11)]) for i in range(600)]
    spark.conf.set(measured, "-1")
    try:
        assert run(spark, rows, k=10, every=20) == brute(rows, 10, 20)
        assert spark.conf.get(static) == before and spark.conf.get(measured) == "-1"
    finally:
        spark.conf.unset(measured)
    assert "SortMergeJoin" in plans["top-lists"] and "BroadcastHashJoin" not in plans["top-lists"]
    assert lists["shards"] * lists["query-blocks"] > lists["top-lists"]  # merged inside a slot
