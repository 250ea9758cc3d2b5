import random

import numpy as np

from bindery.llm import langid
from tests.llm import helpers

PARTS = {"de": ["sch", "ung", "keit", "ein", "der", "ich", "über"], "en": ["the", "ing", "tion", "wh", "ly", "sh", "ou"], "ru": ["при", "ная", "ост", "ели", "тво", "ка"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus():
    rng = random.Random(4)
    return [(i, text(rng, g, rng.randint(3, 60)), g, "a") for i, g in enumerate(rng.choice(list(PARTS)) for _ in range(400))]


def test_viterbi_like_brute_force():
    rng = np.random.default_rng(2)
    scores = [rng.normal(0, 9, (n, 3)).astype(np.float32) for n in (5, 1, 7, 0, 3)]
    for s, path in zip(scores, langid.viterbi(scores, 6.0)):
        if not len(s):
            assert len(path) == 0
            continue

        def cost(p):
            return sum(float(s[t, x]) for t, x in enumerate(p)) - 6.0 * sum(a != b for a, b in zip(p, p[1:]))

        best = max(cost(p) for p in np.ndindex(*[3] * len(s)))
        assert abs(cost(path.tolist()) - best) < 1e-4


def test_held_out_accuracy_and_spans(spark):
    docs = helpers.documents(spark, corpus())
    model = langid.learn(docs)
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang", langid.held_out("doc_id").alias("out")), "doc_id").collect()
    held = [r for r in found if r.out]
    assert len(held) > 50 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    rng = random.Random(1)
    mixed = text(rng, "de", 30) + " " + text(rng, "ru", 20) + " " + text(rng, "en", 10)
    row = langid.identify(helpers.documents(spark, [(1, mixed, None, None)]), model, spans=True).first()
    assert [(s.lang, s.first_word, s.words) for s in row.spans] == [("de", 0, 30), ("ru", 30, 20), ("en", 50, 10)]
    assert row.lang_pred == max(row.spans, key=lambda s: s.letters).lang


def test_held_out_rows_are_never_learned_from(spark):
    rows = corpus()
    import zlib
    spoiled = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else g, s) for i, t, g, s in rows]
    assert "xx" not in langid.learn(helpers.documents(spark, spoiled)).langs


def test_edges(spark):
    docs = helpers.edge_documents(spark)
    model = langid.learn(docs)
    got = {}
    for r in langid.identify(docs, model).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert got[1] == got[2] == got[3] == got[7] == [("und", 0.0)] and len(got[4]) == 2 and None in got
    carried = langid.identify(docs.drop("score"), model, carry=True)
    assert carried.count() == 11 and carried.columns[-2:] == ["lang_pred", "score"]
    empty = helpers.documents(spark, [])
    assert langid.identify(empty, langid.learn(empty)).count() == 0
    assert langid.identify(docs, langid.learn(empty)).filter("lang_pred != 'und'").count() == 0


def test_forgotten_words_change_nothing(spark, monkeypatch):
    """Words are numbers while a group of texts is labelled; forgetting them, and small groups, change no answer."""
    rng = np.random.default_rng(3)
    langs = ["a", "b", "c"]
    logp, scripts = np.log(rng.random((1 << langid.BITS, 3))).astype(np.float32), np.ones((len(langid._NAMES), 3), bool)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(500)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(200)] + ["", "12", "x" * 200]
    model = langid.Model(langs, logp, scripts)
    numbers = [model.numbers(langid._WORD.findall(t)) for t in texts]
    model.scored()
    for t, ns in zip(texts, numbers):
        plain = langid._WORD.findall(t)
        assert model.letters[ns].tolist() == [len(w) for w in plain]
        if plain:
            assert np.allclose(model.table[ns], langid.Model(langs, logp, scripts)._score(plain))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    once = langid.identify(docs, model, spans=True).orderBy("doc_id").collect()
    found = list(map(langid.Model(langs, logp, scripts).numbers, ([w] * 3 for w in words)))
    assert all(len(set(ns.tolist())) == 1 for ns in found)
    assert [r.lang_pred for r in once[-3:]] == ["und", "und", once[-1].lang_pred] and all(sum(s.letters for s in r.spans) == sum(map(len, langid._WORD.findall(t))) for r, t in zip(once, texts))


def test_a_worker_forgets_words():
    """Before, each text's words were strings until its whole group was labelled, and 200 000 words stayed."""
    model = langid.Model(["a"], np.zeros((1 << langid.BITS, 1), np.float32), np.ones((len(langid._NAMES), 1), bool))
    model.numbers([f"w{chr(97 + i % 26)}{i}" for i in range(langid.SCORED * 2 + 5)])
    assert len(model.waiting) == 5
    model.scored()
    assert len(model.table) >= len(model.index) == langid.SCORED * 2 + 5 and not model.waiting
    model.forget()
    assert not model.index and len(model.table) == 4096
