"""Edge tables and brute-force versions that the tests of this folder share."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key long, score double, n long, _text string, component long, sig binary"


def documents(spark, rows):
    """Documents from (doc_id, text, lang, source), with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 1, 2, 0.5, 3, "x", 4, None) for i, t, g, s in rows], SCHEMA)


def prose(rng, words, vocabulary=None):
    vocabulary = vocabulary or ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    return " ".join(rng.choice(vocabulary) for _ in range(words))


def edge_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties."""
    rng = random.Random(3)
    long_ = prose(rng, 30_000)
    rows = [(1, "", "en", "a"), (2, None, None, None), (3, "  \n\t ", "en", "a"), (4, "one two", "en", "a"), (4, "one two", "en", "a"),
            (None, "no id at all here, but some words in the text", "en", "b"), (5, long_, "en", "a"), (6, long_, "en", None), (7, "!!! 123 ---", None, "b"),
            (8, "naïve ÄÖ ß 語 text", "fr", "b"), (9, "one two", None, "b")]
    return documents(spark, rows)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text, size=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def near_duplicates(texts, percent):
    """{id: component} over full sets, every pair compared."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in ids}
