from collections import Counter, defaultdict

from bindery.llm import mixing
from tests.llm import helpers


def test_period_keeps_every_share():
    for units in ({"a": 1}, {"a": 500, "b": 300, "c": 200}, {"a": 997, "b": 1, "c": 2}, {str(i): 10 for i in range(100)}, {"a": 333, "b": 333, "c": 334}):
        period, slots = sum(units.values()), mixing.one_period(units)
        assert sorted(t for s in slots.values() for t in s) == list(range(period))
        for s, u in units.items():
            assert len(slots[s]) == u
            for j, t in enumerate(slots[s]):
                assert j * period // u <= t < -(-(j + 1) * period // u)  # released and not late


def test_whole_weights():
    got = mixing.whole_weights({"a": 0.7, "b": 0.2999, "c": 1e-9})
    assert sum(got.values()) == mixing.UNITS and min(got.values()) == 1


def test_mix_never_a_block_away(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)  # several buckets a source
    sizes = {"big": 500, "mid": 130, "tiny": 9, None: 40}
    rows = [(i, f"t{i}", "en", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    weights = {"big": 0.5, "mid": 0.3, "tiny": 0.2}
    got = mixing.mix(helpers.documents(spark, rows), weights=weights, block_rows=4).orderBy("position").collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows))) and len({r.position for r in got}) == len(rows)
    by_slot = defaultdict(list)
    for r in got:
        by_slot[r.slot].append(r)
        assert r.position // 4 == r.slot
    assert sorted(by_slot) == list(range(len(by_slot)))
    assert all(len({(r.mix_source, r.block) for r in rs}) == 1 for rs in by_slot.values())
    blocks = {s if s else mixing.REST: -(-n // 4) for s, n in sizes.items()}
    units = mixing.whole_weights(weights | {mixing.REST: 0.2})
    placed = Counter()
    for p in mixing.phases(blocks, units):
        share = {s: len(x) for s, x in p.slots.items()}
        assert p.first == {s: placed[s] for s in p.first}
        ran = Counter()
        for t in range(p.length):
            ran[by_slot[p.start + t][0].mix_source] += 1
            for s, w in share.items():
                assert abs(ran[s] - (t + 1) * w / sum(share.values())) < 1
        placed += ran
    assert placed == blocks


def test_edges(spark):
    docs = helpers.edge_documents(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == 11 and len({r.position for r in got}) == 11
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns and rows.count() == 11
    assert mixing.mix(helpers.documents(spark, [])).count() == 0
    assert mixing.mix(docs, weights={"a": 1.0}).count() == 11
