import hashlib
import random

import numpy as np
import pytest

from bindery.llm import suffix
from tests.llm import helpers


def brute(rows):
    """[(id, n_bytes, n_removed, n_spans, sha)] for (id, text) with distinct ids."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s:s + 100] in seen:
                gone[s:s + 100] = b"\1" * 100
            else:
                seen.add(data[s:s + 100])
        spans = sum(1 for j, g in enumerate(gone) if g and (not j or not gone[j - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest()))
    return out


def _texts():
    rng = random.Random(9)
    passages = [helpers.prose(rng, n) for n in (15, 20, 40, 120)]
    texts = []
    for _ in range(60):
        parts = [helpers.prose(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 4))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), p)
        texts.append(" ".join(parts))
    base = helpers.prose(rng, 200)
    for _ in range(15):  # near copies with single changed bytes
        b = list(base)
        for _ in range(rng.randint(0, 6)):
            b[rng.randrange(len(b))] = rng.choice("xyzé")
        texts.append("".join(b))
    texts += [texts[3], texts[4], texts[3], "a" * 99, "a" * 100, "a" * 101, "a" * 400, "ab" * 300, "xyz" * 50, "x" + "yzx" * 90, "", "é" * 80, "é" * 90,
              base[50:149], base[50:150], base[7:107] + "#" + base[8:108]]
    return texts


@pytest.mark.parametrize("hot", [100_000, 3])
def test_like_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = list(enumerate(_texts())) + [(900, None)]
    docs = helpers.documents(spark, [(i, t, "en", "a") for i, t in rows]).repartition(4)
    assert sorted(tuple(r) for r in suffix.remove_repeats(docs).collect()) == brute(rows)


def test_texts_of_several_segments(spark, monkeypatch):
    rng = random.Random(5)
    data = (helpers.prose(rng, 400) + " " + helpers.prose(rng, 100)).encode()
    whole = suffix.runs(data)
    covered = sorted((int(f), int(e)) for f, e in zip(whole[2], whole[3]))
    assert covered[0][0] == 0 and covered[-1][1] == len(data) - 100
    assert all(a[1] + 1 == b[0] for a, b in zip(covered, covered[1:]))


def test_blind_trie_and_multikey_sort():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [b"a" * 30] * 3 + [b"", b"\0", b"\0\0"]
    order, lcp = suffix.blind_trie(strings)
    got = [strings[i] for i in order]
    assert got == sorted(strings) and sorted(order) == list(range(len(strings)))
    group = np.array([rng.randint(0, 4) for _ in strings])
    order, lcp = suffix.deep_shallow(strings, group)
    got = [(group[i], strings[i]) for i in order]
    assert got == sorted(zip(group, strings))
    for (g, a), (h, b), n in zip(got, got[1:], lcp[1:]):
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == (-1 if g != h else common)


def test_edges(spark):
    rows = {(r.doc_id, r.n_bytes): r for r in suffix.remove_repeats(helpers.edge_documents(spark)).collect()}
    assert suffix.remove_repeats(helpers.edge_documents(spark)).count() == 11
    assert rows[(2, 0)].n_removed == 0
    five = next(r for (i, _), r in rows.items() if i == 5)
    six = next(r for (i, _), r in rows.items() if i == 6)
    assert five.n_removed == 0 and six.n_removed == six.n_bytes and six.n_spans == 1
    again = helpers.documents(spark, [(1, "q" + "abcdefghij" * 12, "en", "a")] * 3)
    assert len({tuple(r) for r in suffix.remove_repeats(again).collect()}) == 1
    assert suffix.remove_repeats(helpers.documents(spark, [])).count() == 0
