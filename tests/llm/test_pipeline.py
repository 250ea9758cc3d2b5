"""Each stage of the pipeline against a brute-force version, on its own input."""

import random

import corpus_pipeline as pipeline
from bindery.llm import mixing, secrets
from tests.llm import helpers
from tests.llm.test_packing import check, ids_of

FIELDS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice(["the", "ing", "tion", "er", "an"]) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    rows = []
    for i in range(90):
        text = helpers.prose(rng, rng.randint(8, 120), vocabulary)
        if i % 3 == 0 and rows:
            text = rows[-1][1]
        if i % 10 == 7:
            text = rows[-2][1] + " more"
        if i % 4 == 1:
            text += ' token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"'
        rows.append((i, text, "en" if i % 5 else None, f"s{i % 3}" if i % 7 else None))
    rows += [(200, None, None, None), (201, "", "en", "s0"), (202, "123 456 !!!", "en", "s0"), (203, "the thing and the other", "en", None)]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark):
    assert [f.__name__ for _, f in pipeline.STAGES] == ["languages", "near_duplicates", "secret_scans", "mixed_sources", "packed"]
    docs = documents(spark)
    first = pipeline.languages(spark, docs, "")
    want = {r[0] for r in rows_of(docs) if any(c.isalpha() for c in r[1] or "")}
    assert {r.doc_id for r in first.collect()} == want and first.columns == list(FIELDS) and first.filter("lang is null").isEmpty()

    second = pipeline.near_duplicates(spark, first, "")
    texts = {r.doc_id: r.text for r in first.collect()}
    groups = helpers.near_duplicates(texts, 80)
    assert {r.doc_id for r in second.collect()} == {i for i, g in groups.items() if i == g} and second.columns == list(FIELDS)

    third = pipeline.secret_scans(spark, second, "")
    before = {r.doc_id: r.text for r in second.collect()}
    for r in third.collect():
        planted = 'token = "' in before[r.doc_id]
        assert (secrets.MARKER in r.text) == planted and r.n_chars == len(r.text)
        if not planted:
            assert r.text == before[r.doc_id]

    fourth = pipeline.mixed_sources(spark, third, "")
    assert sorted(rows_of(fourth)) == sorted(rows_of(third)) and fourth.columns == list(FIELDS)
    place = {r.doc_id: r.position for r in mixing.mix(third).collect()}
    order = [place[r.doc_id] for r in fourth.collect()]
    assert order == sorted(order)

    pieces = pipeline.packed(spark, fourth, "").collect()
    check(pieces, {r.doc_id: [*ids_of(r.text), 2] for r in fourth.collect()}, 4096, 128, 4096)


def test_empty_table(spark):
    docs = documents(spark).limit(0)
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_repeated_rows_and_shared_ids(spark):
    rng = random.Random(4)
    a, b, c, d = (helpers.prose(rng, 60) for _ in range(4))
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (1, a, "en", "r"),  # repeats: one stays
            (2, a + " more", "en", "s"), (2, b, "en", "s"),  # the first is a near-duplicate of 1, the second is not
            (3, c, "en", "s"), (4, d, "en", "s"), (4, c, "en", "s"), (None, "no id", "en", "s"), (None, "no id", "en", "s"), (5, None, "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = rows_of(pipeline.near_duplicates(spark, docs.repartition(4), "").select("doc_id", "text", "source"))
    assert sorted(got, key=str) == sorted([(1, a, "r"), (2, b, "s"), (3, c, "s"), (4, d, "s"), (None, "no id", "s"), (5, None, "s")], key=str)


def test_packing_takes_the_order_of_the_mix(spark, monkeypatch):
    docs = documents(spark).filter("text is not null")
    place = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(pipeline.packing, "pack", lambda rows, tokenizer: rows)
    order = [place[r.doc_id] for r in pipeline.packed(spark, pipeline.mixed_sources(spark, docs, "").repartition(7), "").collect()]
    assert order == sorted(order) and len(order) == len(place)
