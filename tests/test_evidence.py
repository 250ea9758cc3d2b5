import difflib

import pytest

from bindery.operators import evidence as E

PAGE = "Intro text.\n# Coverage\nThe building value was assessed at ninety thousand dollars by the county surveyor in March.\nTail of the page."


def locate(spark, citation, *texts):
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts, 1)], "document_id long, page_number int, text string")
    cites = spark.createDataFrame([(1, "f", citation)], "document_id long, field_name string, source_text string")
    return E.map_citations(cites, pages).collect()


def test_exact_case_and_missing(spark):
    hit = locate(spark, "  ninety thousand ", "first page", PAGE)[0]
    assert (hit.page_number, hit.match_method, hit.confidence, hit.section, hit.matched_text) == (2, "exact", 1.0, "Coverage", "ninety thousand")
    hit = locate(spark, "NINETY THOUSAND", PAGE)[0]
    assert (hit.page_number, hit.match_method, hit.confidence) == (1, "case_insensitive", 0.9)
    miss = locate(spark, "nothing like it", PAGE)[0]
    assert (miss.page_number, miss.match_method, miss.confidence, miss.section) == (None, "not_found", 0.0, None)
    blank = locate(spark, "   ", PAGE)[0]
    assert blank.match_method == "not_found"
    assert locate(spark, "", PAGE) == []


HEADINGS = [("# A\nshort\n", "A"), ("### B\n", "B"), ("#### C\n", None), ("ALL CAPS HERE\n\n", "ALL CAPS HERE"), ("ABC\n", None), ("ABCD\n", "ABCD"),
            ("ABCD 12\n", None), ("# Far\n" + "x" * 81 + "\n", None), ("# Near\n" + "x" * 80 + "\n", "Near"), ("# One\nTWO WORDS\nmiddle\n", "TWO WORDS")]


@pytest.mark.parametrize("before,section", HEADINGS)
def test_heading(spark, before, section):
    assert locate(spark, "the citation", before + "the citation")[0].section == section


def brute_fuzzy(citation, pages):
    best = (0.0, None, None)
    if len(citation) < 20:
        return best
    size = max(len(citation), 300)
    for number, text in pages:
        if not text:
            continue
        for start in range(0, max(1, len(text) - size + 1), max(1, size // 4)):
            window = text[start:start + size]
            r = difflib.SequenceMatcher(None, citation, window).ratio()
            if r > best[0] and r >= 0.75:
                best = (r, number, window)
    return best


def test_fuzzy_against_brute_force(spark):
    import random
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    pages, cites = [], []
    for d in range(12):
        texts = [" ".join(rng.choices(words, k=rng.randint(5, 160))) for _ in range(3)]
        pages += [(d, i, t) for i, t in enumerate(texts, 1)]
        source = texts[rng.randrange(3)]
        size = rng.choice([15, 25, 60, 190, 240, 290])
        at = rng.choice([0, 75, 150, rng.randrange(max(1, len(source) - size))])
        quote = list(source[at:at + size])
        for i in range(0, len(quote), 40):
            quote[i] = "~"
        cites.append((d, "f", "".join(quote).strip()))
    p = spark.createDataFrame(pages, "document_id long, page_number int, text string")
    c = spark.createDataFrame(cites, "document_id long, field_name string, source_text string")
    got = {r.document_id: r for r in E.map_citations(c, p).collect()}
    for d, _, quote in cites:
        mine = [(n, t) for doc, n, t in pages if doc == d]
        r, number, window = brute_fuzzy(quote, mine)
        assert got[d].page_number == number
        assert got[d].matched_text == window
        assert got[d].confidence == pytest.approx(round(r, 3), abs=1e-9)
    assert any(r.match_method == "fuzzy" for r in got.values())
