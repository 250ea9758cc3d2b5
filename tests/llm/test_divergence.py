import random
import re
from collections import Counter, defaultdict

import numpy as np

from bindery.llm import divergence
from tests.llm import helpers


def brute(rows, min_docs, top=50):
    """The contract over whole vocabularies, term by term."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own = {s: c for (g, s), c in groups.items() if g == lang}
        whole = shares(sum(own.values(), Counter()))
        p = {s: shares(c) for s, c in own.items()}
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(p[s][t] - whole[t], t) for t in kept if own[s][t] > 0 and p[s][t] > whole[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(items[:limit], 1)}
    return out


def sample(n, sources):
    rng = random.Random(12)
    vocabulary = [helpers.prose(rng, 1) + c for c in ("", "é", "Z", "語") for _ in range(120)]
    names = [f"s{i}" for i in range(sources)] + [None, "ähm"]
    return [(i, helpers.prose(rng, rng.randint(0, 60), vocabulary), rng.choice(["en", "fr", "", None]), names[min(int(rng.expovariate(0.15)), len(names) - 1)]) for i in range(n)]


def check(spark, rows, **how):
    found = divergence.audit(helpers.documents(spark, rows).repartition(3), **how)
    got = [tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()]
    want = brute(rows, **how)
    assert len(got) == len(set(got)) and set(got) == want
    return want


def test_like_brute_force(spark):
    want = check(spark, sample(600, 12), min_docs=5)
    assert {r[2] for r in want} == {"pair", "term"}
    check(spark, sample(300, 5), min_docs=3, top=7)


def test_many_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 37)
    monkeypatch.setattr(divergence, "TILE", 4)
    monkeypatch.setattr(divergence, "FLUSH", 100)
    check(spark, sample(500, 30), min_docs=4)


def test_no_kept_terms_and_edges(spark):
    rows = [(1, "one two", "en", "a"), (2, None, "en", "b"), (3, "", None, None), (4, "!!", "fr", "x"), (4, "!!", "fr", "x"), (None, "word", "fr", None)]
    want = check(spark, rows, min_docs=30)
    assert ("en", "a", "pair", "b", 0, 1) in want and not any(r[2] == "term" for r in want)
    assert divergence.audit(helpers.documents(spark, [])).count() == 0
    edge = [tuple(r) for r in helpers.edge_documents(spark).select("doc_id", "text", "lang", "source").collect()]
    check(spark, edge, min_docs=2)


def test_columns_of_runs():
    rng = np.random.default_rng(3)
    for size in (1, 7, 300):
        a, b = (rng.integers(0, 3, size) for _ in range(2))
        runs = [(f := np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), x[f]) for x in (a, b)]
        assert divergence.distance(*runs, size) == np.abs(a - b).sum()


def test_shares_of_counts_beyond_64_bits(spark):
    n, total, kept = 3_000_000_000_000_000, 7_000_000_000_000_000, 12_345
    row = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").select(divergence.share("n", "total", "kept").alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 5) // (total + 5 * kept)
