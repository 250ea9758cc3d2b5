"""Grams of a batch are kept as columns: no object for each gram."""

import random
import tracemalloc

import pyarrow as pa

from bindery.functions.grams import grams, kept_grams


def test_a_batch_of_pages_takes_some_bytes_a_gram():
    rng = random.Random(3)
    pages = ["".join(rng.choices("abcdefghij klmnop", k=1500)) for _ in range(300)] + ["", None]
    texts, tiers = pa.array(pages), pa.array([[0, 1]] * len(pages), pa.list_(pa.int32()))
    tracemalloc.start()
    out = grams.func(texts, tiers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in out] == [sum(len(kept_grams(t, i)) for i in (0, 1)) if t else 0 for t in pages]
    assert peak < 60 * len(out.values)
