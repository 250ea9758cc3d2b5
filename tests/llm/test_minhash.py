import random

import numpy as np
import pytest

from bindery.llm import minhash
from bindery.llm.components import components
from tests.llm import helpers


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 500)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    assert got == {i: find(i) for i in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.7, 0.9):
        pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        both = int(4000 * share)
        a, b = np.unique(pool[:both + (4000 - both) // 2]), np.unique(np.r_[pool[:both], pool[both + (4000 - both) // 2:]])
        equal = (minhash.registers(a) == minhash.registers(b)).sum()
        assert abs(float(minhash.estimate(equal, len(a), len(b))) - share) < 0.15


def _groups(rng):
    """Copies, chains of edits, a large star whose centre has not the smallest id, shared passages, short texts."""
    texts, at = {}, 0

    def put(text):
        nonlocal at
        texts[at] = text
        at += 1

    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    passage = helpers.prose(rng, 60, vocabulary)

    def edited(text, n):
        w = text.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return " ".join(w)

    for n in (5, 6, 7, 8, 12, 60, 200):
        base = helpers.prose(rng, n, vocabulary)
        for _ in range(3):
            put(base)
        put(base.upper())
        put(edited(base, 1))
        put(base + " tail")
    chain = helpers.prose(rng, 150, vocabulary)
    for _ in range(12):
        put(chain)
        chain = edited(chain, 2)
    centre = helpers.prose(rng, 300, vocabulary)
    for _ in range(60):
        put(edited(centre, 4))
    put(centre)
    for _ in range(40):
        put(passage + " " + helpers.prose(rng, 25, vocabulary))
    for _ in range(60):
        put(helpers.prose(rng, rng.randint(1, 80), vocabulary))
    put("")
    put(None)
    return texts


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_like_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)  # several blocks in one bucket
    texts = _groups(random.Random(11))
    docs = helpers.documents(spark, [(i, t, "en", "a") for i, t in texts.items()])
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, percent=percent).collect()}
    want = helpers.near_duplicates(texts, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) and r.n_shingles == len(helpers.shingles(texts[i])) for i, r in got.items())


def test_edges(spark):
    rows = minhash.near_duplicates(helpers.edge_documents(spark)).collect()
    assert len(rows) == 11
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[4] == [(1, 4, True)] * 2 and got[9] == [(1, 4, False)]
    assert got[6][0][1:] == (5, False) and got[5][0][1:] == (5, True)
    assert got[None][0][1:] == (None, True)
    assert minhash.near_duplicates(helpers.documents(spark, [])).count() == 0


def test_no_join_is_broadcast_by_an_estimate(spark, monkeypatch):
    """Bands are 32 rows for each document, which Spark's estimate does not count."""
    plans, written = {}, minhash.written

    def watched(df, purpose):
        plans[purpose] = df._jdf.queryExecution().sparkPlan().toString()
        return written(df, purpose)

    monkeypatch.setattr(minhash, "written", watched)
    texts = _groups(random.Random(12))
    docs = helpers.documents(spark, [(i, t, "en", "a") for i, t in texts.items()])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, percent=80).collect()}
    assert got == helpers.near_duplicates(texts, 80)
    joined = [plans[p] for p in ("star-pairs", "star-candidates", "mixed-buckets", "hub-pairs")]
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in joined)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
