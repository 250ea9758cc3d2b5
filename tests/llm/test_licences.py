import random
import re

import pytest

from bindery.llm import licences
from tests.llm import helpers

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute(text):
    """Base columns: every place tried, word by word."""
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for i in range(len(words)):
        for phrase, label in PHRASES.items():
            p = phrase.split()
            if words[i:i + len(p)] == p:
                places.append((i, label))
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def notices(text):
    """Labels of notice phrases and base phrases, by a search in the words."""
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    plain = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    return {x for p, x in PHRASES.items() if f" {p} " in plain} | {x for p, x, _ in licences.NOTICES if f" {p} " in plain}


def sample():
    rng = random.Random(8)
    parts = ["cc by", "CC-BY", "CC BY-SA 4.0", "General\tPublic  License", "GENERAL PUBLIC LICENSE version 3", "all rights", "reserved", "All rights reserved.", "rights", "cc", "by",
             "MIT License", "Apache License, Version 2.0", "lesser general public license", "été", " ", "K", "İ", "x_y", "all\nrights\nreserved", "generalpublic license", "\x00"]
    made = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    return [None, "", " ", "cc by cc by", "all rights reserved all rights reserved", "éall rights reserved", "all rights reserved1"] + made


def test_base_and_notices_like_brute_force(spark):
    texts = sample()
    docs = helpers.documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).repartition(3)
    for r in licences.scan(docs).collect():
        text = texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), repr(text)
        assert r.labels == ",".join(sorted(notices(text))) and 0 <= r.score <= 1


def test_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    rows = licences.scan(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(notices(texts[r.doc_id])) == set(filter(None, r.labels.split(",")))


@pytest.mark.parametrize("text, order, duty, labels", [
    ("MIT", "mit", "notice", {"mit"}),
    ("MIT OR Apache-2.0 */", "mit apache-2.0 or", "notice", {"mit", "apache-2.0"}),
    ("GPL-2.0-only AND MIT OR Zlib", "gpl-2.0-only mit and zlib or", "notice", {"gpl-2.0", "mit", "zlib"}),
    ("GPL-2.0-only AND (MIT OR Zlib)", "gpl-2.0-only mit zlib or and", "share-work", {"gpl-2.0", "mit", "zlib"}),
    ("GPL-2.0+ WITH Classpath-exception-2.0 OR AGPL-3.0", "gpl-2.0+ classpath-exception-2.0 with agpl-3.0 or", "share-file", {"gpl-2.0", "agpl-3.0"}),
    ("MIT OR", "mit", "notice", {"mit"}), ("MIT or see the file", "mit", "notice", {"mit"}), ("(MIT", None, None, None), ("AND MIT", None, None, None),
    ("((MIT)) and mpl-2.0", "mit mpl-2.0 and", "share-file", {"mit", "mpl-2.0"}), ("Frobnicate-1.0", "frobnicate-1.0", None, {"unknown"}),
    ("LicenseRef-mine OR MIT", "licenseref-mine mit or", "notice", {"licenseref", "mit"}), ("LicenseRef-mine AND MIT", "licenseref-mine mit and", None, {"licenseref", "mit"}),
    ("(MIT OR (GPL-3.0)", None, None, None), ("MIT) OR Zlib", "mit", "notice", {"mit"}), ("MIT.", "mit", "notice", {"mit"}),
])
def test_expressions(text, order, duty, labels):
    found = licences.postfix(text, strict=False)
    assert found == (order.split() if order else None)
    if order:
        assert licences.evaluate(found) == (duty, labels)


def test_random_expressions_like_recursive_evaluation():
    rng = random.Random(9)
    names = sorted(licences.IDENTIFIERS)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(names)
            return name, licences.OBLIGATIONS.index(licences.IDENTIFIERS[name])
        (a, x), (b, y) = made(depth - 1), made(depth - 1)
        op = rng.choice(["or", "and"])
        return f"({a}) {op.upper()} ({b})", (min if op == "or" else max)(x, y)

    for _ in range(300):
        text, value = made(4)
        order = licences.postfix(text, strict=True)
        assert order is not None and licences.evaluate(order)[0] == licences.OBLIGATIONS[value]


def test_tags_in_texts(spark):
    texts = ["// SPDX-License-Identifier: MIT OR GPL-3.0-or-later\ncode", 'license = "Apache-2.0"', "License: proprietary stuff", "the license of this", "SPDX-License-Identifier: (MIT\n",
             "é SPDX-License-Identifier: BSD-3-Clause AND LGPL-2.1+ -->", "license: MIT\nlicense: GPL-2.0"]
    docs = helpers.documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    rows = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert [rows[i].labels for i in range(7)] == ["gpl-3.0,mit", "apache-2.0", "", "", "invalid", "bsd-3-clause,lgpl-2.1", "gpl-2.0,mit"]
    assert [rows[i].obligation for i in range(7)] == ["notice", "notice", None, None, None, "share-file", "share-work"]
    assert rows[0].findings[0].expression == "mit gpl-3.0-or-later or" and rows[5].findings[0].word == 1


def test_edges(spark):
    docs = helpers.edge_documents(spark)
    rows = licences.scan(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.n_base == 0 and r.first_word is None and r.base_labels == "" == r.labels and r.score == 0
    assert licences.scan(helpers.documents(spark, [])).count() == 0
    long_ = "all rights reserved " * 50_000
    assert licences.scan(helpers.documents(spark, [(1, long_, "en", "a")])).first().n_base == 50_000
