"""Bounds that keep windows from being compared: never below what ``difflib`` finds, and low for unrelated prose."""

import difflib
import random

import numpy as np

from bindery.functions import grams as G

LETTERS = "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def codes(text):
    return np.array([ord(c) for c in text], np.int64)


def test_coverable_is_an_upper_bound():
    rng = random.Random(5)
    for _ in range(600):
        letters = LETTERS[:rng.choice([2, 3, 6, 30, 60])]
        a = "".join(rng.choices(letters, k=rng.randint(1, 260)))
        b = list(a if rng.random() < 0.7 else rng.choices(letters, k=rng.randint(1, 330)))
        for _ in range(rng.randint(0, 60)):
            b[rng.randrange(len(b))] = rng.choice(letters)
        if rng.random() < 0.6:
            b = rng.choices(letters, k=rng.randint(0, 100)) + b + rng.choices(letters, k=rng.randint(0, 100))
        found = difflib.SequenceMatcher(None, a, "".join(b)).get_matching_blocks()
        assert sum(m.size for m in found) <= G.coverable(codes(a), codes("".join(b)))


def test_best_of_noisy_prose_with_few_comparisons(monkeypatch):
    """Quotes of 250 characters of prose: before, almost every window went through the common subsequence."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("eeetaoinshrdlucmfwyp", k=rng.randint(2, 9))) for _ in range(300)]
    calls, plain = [], G.common_subsequence
    monkeypatch.setattr(G, "common_subsequence", lambda a, b: calls.append(1) or plain(a, b))
    windows = 0
    for i in range(20):
        page = " ".join(rng.choices(vocabulary, k=300))[:1500]
        other = " ".join(rng.choices(vocabulary, k=300))
        quote = page[500:750] if i % 2 else other[:250]
        quote = "".join(c if rng.random() > 0.05 else "~" for c in quote)
        want = None
        for start in range(0, len(page) - 300 + 1, 75):
            windows += 1
            cut = page[start:start + 300]
            ratio = difflib.SequenceMatcher(None, quote, cut).ratio()
            if ratio >= 0.75 and (want is None or ratio > want[2]):
                want = start, cut, ratio
        assert G.Passage(quote).best(G.Page(page), 300, 0.75) == want
    assert len(calls) < windows / 4
