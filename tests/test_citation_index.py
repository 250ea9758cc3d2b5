import difflib
import random

import pytest
from pyspark.sql import functions as F

from bindery.functions import grams as G
from bindery.operators import evidence as E

PAGES = "document_id long, page_number int, text string"
CITES = "document_id long, field_name string, source_text string"


def prose(rng, n, letters="abcdefghij  ÄÖß"):
    return "".join(rng.choice(letters) for _ in range(n))


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_kept_grams_of_a_passage_are_among_those_of_the_text():
    rng = random.Random(1)
    for _ in range(300):
        text = prose(rng, rng.randint(1, 400))
        n = rng.randint(1, len(text))
        at = rng.randint(0, len(text) - n)
        tier = next(i for i, (q, w) in enumerate(G.TIERS) if n >= q + w - 1)
        mine = set(G.kept_grams(text[at:at + n], tier).tolist())
        assert mine and mine <= set(G.kept_grams(text, tier).tolist())


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(60):
        a, b = (prose(rng, rng.randint(0, 90), "abcde") for _ in range(2))
        assert G.common_subsequence(a, b) == subsequence(a, b)


def slow(citation, text, window, least):
    size, best = max(len(citation), window), None
    for start in range(0, max(1, len(text) - size + 1), max(1, size // 4)):
        r = difflib.SequenceMatcher(None, citation, text[start:start + size]).ratio()
        if r >= least and (best is None or r > best[2]):
            best = start, text[start:start + size], r
    return best


@pytest.mark.parametrize("least", [0.3, 0.55, 0.75])
def test_best_window_like_all_windows(least):
    rng = random.Random(3)
    hits = 0
    for _ in range(150):
        text = prose(rng, rng.randint(1, 500), rng.choice(["abc ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]))
        size = rng.randint(1, 120)
        at = rng.randrange(len(text))
        quote = list(text[at:at + size]) if rng.random() < 0.7 else list(prose(rng, size))
        for i in range(0, len(quote), rng.randint(3, 30)):
            quote[i] = "~"
        quote = "".join(quote) or "x"
        want = slow(quote, text, 60, least)
        assert G.Passage(quote).best(G.Page(text), 60, least) == want
        hits += want is not None
    assert hits > 10


def tables(spark):
    rng = random.Random(5)
    pages, cites = [], []
    for d in range(25):
        texts = [prose(rng, rng.randint(0, 900)) for _ in range(12)]
        pages += [(d, i, t) for i, t in enumerate(texts, 1)]
        for k in range(12):
            t = rng.choice([t for t in texts if t])
            n = rng.choice([1, 2, 3, 5, 14, 15, 40, 200])
            at = rng.randrange(len(t))
            quote = t[at:at + n]
            cites.append((d, f"f{k}", rng.choice([quote, quote.upper(), quote.lower(), quote + "#"])))
    return pages, cites + [(0, "sigma", "ΟΔΟΣ"), (0, "none", None), (99, "no pages", "some quote that is long enough")], [(0, 50, "ΟΔΟΣ ΜΕΓΑΛΗ ΟΔΟΣΑ")]


def brute(cite, pages):
    c = cite.strip()
    for number, text in pages:
        if c in text:
            return number, "exact"
    for number, text in pages:
        if c.lower() in text.lower():
            return number, "case_insensitive"
    return None


def test_location_like_every_page(spark):
    pages, cites, greek = tables(spark)
    pages += greek
    found = E.locate_verbatim(spark.createDataFrame(cites, CITES), spark.createDataFrame(pages, PAGES))
    got = {(r.document_id, r.field_name): (r.page_number, r.match_method) for r in found.collect()}
    want = {}
    for d, f, quote in cites:
        if quote and quote.strip():
            hit = brute(quote, [(n, t) for doc, n, t in pages if doc == d])
            if hit:
                want[d, f] = hit
    assert got == want and len(want) > 100


def test_a_citation_meets_few_pages(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    pages = [(1, i, prose(rng, 1500, letters)) for i in range(1, 201)]
    cites = [(1, f"f{i}", pages[i * 3][2][100:160]) for i in range(60)]
    keyed = E._keyed(spark.createDataFrame(cites, CITES))
    met = E.candidate_pages(keyed, spark.createDataFrame(pages, PAGES))
    assert 60 <= met.count() <= 70  # of 12 000 pairs
    plan = met._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], CITES), spark.createDataFrame([(1, 1, "text")], PAGES)
    assert E.map_citations(none, some).count() == 0
    row = E.map_citations(spark.createDataFrame([(1, "f", "x")], CITES), spark.createDataFrame([], PAGES)).first()
    assert row.match_method == "not_found"
    assert E.fuzzy_matches(spark.createDataFrame([], "document_id long, _cite string, _citation string"), some).filter(F.lit(True)).count() == 0


def test_grams_that_no_citation_has_do_not_leave_the_page(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    pages = [(d, i, prose(rng, 1500, letters)) for d in range(5) for i in range(1, 9)]
    cites = [(d, i, t[100:140]) for d, i, t in pages if i % 2]
    wanted = [(d, 0, int(g)) for d, _, t in cites for g in G.kept_grams(t, 0)]
    wanted = spark.createDataFrame(wanted, "document_id long, tier int, gram long")
    table = spark.createDataFrame(pages, PAGES)
    sent, kept = E._postings(wanted, table), E.page_index(wanted, table)
    assert kept.count() >= wanted.distinct().count() and kept.exceptAll(sent.select(*kept.columns)).isEmpty()
    assert sent.count() < 1.1 * kept.count() + 20 < sum(len(G.kept_grams(t, 0)) for _, _, t in pages) / 10
