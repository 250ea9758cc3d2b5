import math
import random
import re
from collections import Counter, defaultdict

import pytest

from bindery.llm import quality
from tests.llm import helpers


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = text.split("\n"), 0
    for i, x in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def kneser_ney(texts, word):
    """Log-probability of a word's characters by modified Kneser-Ney, straight from the definition."""
    n_max = quality.ORDER
    counts = Counter()
    for t in texts:
        for w in t.split():
            s = quality.shape(w)
            for i in range(1, len(s)):
                counts[s[max(0, i - n_max + 1):i + 1]] += 1
    level = {n_max: Counter({g: c for g, c in counts.items() if len(g) == n_max})}
    for k in range(n_max - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
        level[k].update({g: c for g, c in counts.items() if len(g) == k and g[0] == "\x02"})
    alphabet = len(level[1])

    def cut(k, c):
        t = Counter(min(x, 5) for x in level[k].values())
        y = t[1] / max(1, t[1] + 2 * t[2])
        i = min(c, 3)
        d = i - (i + 1) * y * t[i + 1] / t[i] if t[i] else 0.5
        return max(0.05, min(d, i - 0.05))

    followers = defaultdict(list)
    for k in level:
        for g, c in level[k].items():
            followers[k, g[:-1]].append(c)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (alphabet + 1)
        f = followers.get((k, g[:-1]))
        if not f:
            return p(g[1:])
        c = level[k].get(g, 0)
        own = (c - cut(k, c)) / sum(f) if c else 0
        return own + sum(cut(k, x) for x in f) / sum(f) * p(g[1:])

    s = quality.shape(word)
    return sum(math.log(p(s[max(0, i - n_max + 1):i + 1])) for i in range(1, len(s)))


def corpus():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice(["the", "an", "re", "ti", "on", "er"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    rows = [(i, helpers.prose(rng, rng.randint(60, 120), vocabulary), "en", "a") for i in range(80)]
    rows.append((200, " ".join("".join(rng.choice("qxzvkjw") for _ in range(6)) for _ in range(80)), "en", "a"))
    rows.append((201, "spam eggs ham " * 40, "en", "a"))
    rows.append((202, "line one here\nline one here\n\n\n x \n x ### $", None, "a"))
    return rows


def test_model_is_kneser_ney(spark):
    texts = [t for _, t, g, _ in corpus() if g == "en"][:30]
    model = quality.learn(helpers.documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]))
    for word in ("the", "reonti", "xyz", "Theon9", "anan", texts[0].split()[3]):
        assert model.words("en", [word])[0] == pytest.approx(kneser_ney(texts, word), abs=2e-3)


def test_rules(spark):
    rows = corpus()
    got = {r.doc_id: r for r in quality.judge(helpers.documents(spark, rows)).collect()}
    for i, t, _, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t)
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert r.kept == (i < 200)


def test_edges(spark):
    rows = quality.judge(helpers.edge_documents(spark)).collect()
    assert len(rows) == 11 and not any(r.kept for r in rows if (r.n_words or 0) < 50)
    assert next(r for r in rows if r.doc_id == 2).n_words == 0
    assert quality.judge(helpers.documents(spark, [])).count() == 0


def test_bands_reject_what_labels_call_bad(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    rows = quality.judge(docs).filter("not base_failed").join(labels, "doc_id").selectExpr("quality", "cast(kept as int) as k").groupBy("quality").agg({"k": "avg"}).collect()
    kept = {r[0]: r[1] for r in rows}
    assert kept[1] > 0.985 and kept[0] < 0.75
