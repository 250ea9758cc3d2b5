import difflib

from bindery.functions import similarity as S


def test_repeated_short_pairs_are_compared_once(monkeypatch):
    made = []

    class Counting(difflib.SequenceMatcher):
        def __init__(self, *args):
            made.append(args)
            super().__init__(*args)

    want = {(a, b): difflib.SequenceMatcher(None, a, b).ratio() for a, b in (("acme roofing", "acme roofing inc"), ("acme roofing inc", "acme roofing"), ("x" * 300, "y" * 300 + "x"))}
    monkeypatch.setattr(S.difflib, "SequenceMatcher", Counting)
    for _ in range(5):
        for (a, b), r in want.items():
            assert S.ratio(a, b) == r
    assert len(made) <= 2 + 5
    assert S.ratio(None, "a") is None and S.ratio("a", None) is None
