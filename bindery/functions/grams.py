"""Character grams of texts: keys for looking up substrings, bounds for similar ones."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from bindery.functions.text import col

#: (gram length, neighbouring grams of which the smallest hash is kept): a passage of gram + neighbours - 1
#: characters has at least one kept gram, and so has every text that holds it. Longest passages first.
TIERS = ((8, 8), (3, 1), (1, 1))

JUNK_FROM = 200  # length from which ``difflib`` sets characters apart that are more than one hundredth of a text, and one


def folded(c: Column | str) -> Column:
    """Lower case in which a part of a text folds to a part of the folded text: the one letter whose lower case depends on its place has one form."""
    return F.translate(F.lower(col(c)), "ς", "σ")


def tier_of(length: Column) -> Column:
    """Index of the first tier that serves a passage of that many characters; null for an empty one."""
    out = F.lit(None).cast("int")
    for i, (q, w) in reversed(list(enumerate(TIERS))):
        out = F.when(length >= q + w - 1, i).otherwise(out)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kept_grams(text: str, tier: int) -> np.ndarray:
    """Distinct 64-bit hashes of the grams that a tier keeps of a folded text."""
    q, w = TIERS[tier]
    codes = _codes(text).astype(np.uint64)
    n = len(codes) - q + 1
    if n < w:
        return np.empty(0, np.int64)
    acc = np.zeros(n, np.uint64)
    for j in range(q):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + codes[j:j + n] + np.uint64(1)
    acc ^= acc >> np.uint64(29)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    acc ^= acc >> np.uint64(32)
    if w > 1:
        acc = np.lib.stride_tricks.sliding_window_view(acc, w).min(axis=1)
    return np.unique(acc).view(np.int64)


_GRAMS = T.ArrayType(T.StructType([T.StructField("tier", T.IntegerType()), T.StructField("gram", T.LongType())]))
PLACES = 8 * 4096  # bits of Spark's ``bitmap_construct_agg``


def place_of(gram: Column | str) -> Column:
    """A gram's bit in a bitmap of grams."""
    return F.pmod(col(gram), F.lit(PLACES))


def _listed(text: pa.Array, tiers: pa.Array, maps: pa.Array | None = None) -> pa.Array:
    ends, names, found = [0], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for row, (t, wanted) in enumerate(zip(text, tiers)):
        t, n = t.as_py(), ends[-1]
        for i in (wanted.as_py() or ()) if t else ():
            kept = kept_grams(t, i)
            if maps is not None:
                place = kept & (PLACES - 1)
                kept = kept[np.frombuffer(maps[row].as_py(), np.uint8)[place >> 3] >> (place & 7) & 1 == 1]
            found.append(kept)
            names.append(np.full(len(found[-1]), i, np.int32))
            n += len(found[-1])
        ends.append(n)
    rows = pa.StructArray.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(found))], names=["tier", "gram"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


@F.arrow_udf(_GRAMS)
def grams(text: pa.Array, tiers: pa.Array) -> pa.Array:
    """Kept grams of folded texts in each of the asked tiers; a batch is 12 bytes a gram, never an object each."""
    return _listed(text, tiers)


@F.arrow_udf(_GRAMS)
def grams_of_map(text: pa.Array, tiers: pa.Array, maps: pa.Array) -> pa.Array:
    """Those of ``grams`` whose bit is set in the row's bitmap: all that are looked for, and others where a bit stands for several."""
    return _listed(text, tiers, maps)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one number."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def coverable(a: np.ndarray, b: np.ndarray) -> int:
    """Most characters of ``a`` that ``difflib`` can match in ``b``: those in equal runs with a rare character of ``b``, or from where both begin.

    A matching block is part of a run of equal characters at one distance. It holds
    a character that is not frequent in ``b``; only where both texts begin it need not.
    """
    names, place, times = np.unique(b, return_inverse=True, return_counts=True)
    rare = times[place] <= len(b) // 100 + 1 if len(b) >= JUNK_FROM else np.ones(len(b), bool)
    anchors = np.flatnonzero(rare)
    i, j = np.nonzero(a[:, None] == b[anchors])
    apart = np.unique(np.append(anchors[j] - i, 0))  # distances at which something can match
    at = np.arange(len(a)) + apart[:, None]
    inside = (at >= 0) & (at < len(b))
    at = np.where(inside, at, 0)
    same = np.zeros((len(apart), len(a) + 1), bool)  # a last column keeps runs of different distances apart
    same[:, :-1] = inside & (b[at] == a)
    anchored = np.zeros_like(same)
    anchored[:, :-1] = same[:, :-1] & (rare[at] | ((at == 0) & (np.arange(len(a)) == 0)))
    flat = same.ravel()
    run = np.cumsum(flat & ~np.append(False, flat[:-1]))
    kept = np.zeros(run[-1] + 1, bool)
    kept[run[anchored.ravel()]] = True
    return int((same & kept[run].reshape(same.shape)).any(axis=0).sum())


class Page:
    """A page's characters and pairs of characters by place."""

    def __init__(self, text: str):
        self.text = text
        self.codes = _codes(text).astype(np.int64)
        self.pairs = (self.codes[:-1] << 21) | self.codes[1:]


class Passage:
    """A passage to look for: how often it has each character and each pair of neighbours."""

    def __init__(self, text: str):
        self.text = text
        self.codes = codes = _codes(text).astype(np.int64)
        self.chars = np.unique(codes, return_counts=True)
        self.pairs = np.unique((codes[:-1] << 21) | codes[1:], return_counts=True)

    @staticmethod
    def _counts(table: tuple[np.ndarray, np.ndarray], values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each window of ``values`` has each item of the table."""
        names = table[0]
        if not len(names) or not len(values) or not len(starts):
            return np.zeros((len(starts), len(names)), np.int64)
        at = np.minimum(np.searchsorted(names, values), len(names) - 1)
        ours = np.flatnonzero(names[at] == values)
        low, high = np.searchsorted(ours, starts), np.searchsorted(ours, np.maximum(ends, starts))
        window = np.repeat(np.arange(len(starts)), high - low)
        place = np.arange(len(window)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[window]
        return np.bincount(window * len(names) + at[ours[place]], minlength=len(starts) * len(names)).reshape(len(starts), len(names))

    def best(self, page: Page, window: int, least: float) -> tuple[int, str, float] | None:
        """(start, window, ratio) of the most similar window of at least ``least``, the first of equals.

        With M matching characters in blocks, a ratio is 2 M / T for T characters in
        all. M is at most the common characters; two blocks are parted by an
        unmatched character, so there are at most T - 2 M + 1 of them, each of which
        has one pair less than characters: the common pairs are at least 3 M - T - 1.
        In a window of ``JUNK_FROM`` characters ``difflib`` begins no block with a
        character that is frequent there, except where both texts begin: there are at
        most as many blocks as common rare characters and one, so M is at most the
        common pairs, these characters and one. And M is at most what ``coverable`` says
        and the longest common subsequence. Windows are tried from the best bound on, only while the bound
        reaches what was found.
        """
        n, length = len(self.text), len(page.text)
        size = max(n, window)
        starts = np.arange(0, max(1, length - size + 1), max(1, size // 4))
        ends = np.minimum(starts + size, length)
        total = n + ends - starts
        bound = 2 * np.minimum(n, ends - starts) / total
        near = np.flatnonzero(bound >= least)
        if not len(near):
            return None
        starts, ends, total = starts[near], ends[near], total[near]
        counts = self._counts(self.chars, page.codes, starts, ends)
        shared, often = np.minimum(counts, self.chars[1]), np.where(ends - starts >= JUNK_FROM, (ends - starts) // 100 + 1, size)
        rare = np.where(counts <= often[:, None], shared, 0).sum(axis=1)
        bound = 2 * shared.sum(axis=1) / total
        near = np.flatnonzero(bound >= least)
        starts, ends, total, bound, rare = starts[near], ends[near], total[near], bound[near], rare[near]
        pairs = np.minimum(self._counts(self.pairs, page.pairs, starts, ends - 1), self.pairs[1]).sum(axis=1)
        bound = np.minimum(bound, 2 * np.minimum((pairs + total + 1) // 3, pairs + rare + 1) / total)
        found: tuple[float, int, str] | None = None
        for i in np.lexsort((starts, -bound)).tolist():
            need = max(least, found[0]) if found else least
            if bound[i] < need:
                break
            if 2 * coverable(self.codes, page.codes[starts[i]:ends[i]]) / total[i] < need:
                continue
            cut = page.text[starts[i]:ends[i]]
            if 2 * common_subsequence(self.text, cut) / total[i] < need:
                continue
            ratio = difflib.SequenceMatcher(None, self.text, cut).ratio()
            if ratio >= least and (found is None or (ratio, -int(starts[i])) > (found[0], -found[1])):
                found = ratio, int(starts[i]), cut
        return (found[1], found[2], found[0]) if found else None


def similar_windows(window: int, least: float):
    """UDF (passages, text) -> the best window of the text for each passage that has one."""
    @F.pandas_udf("array<struct<key: string, start: int, window: string, ratio: double>>")
    def run(passages: pd.Series, texts: pd.Series) -> pd.Series:
        out, known = [], {}
        for wanted, text in zip(passages, texts):
            page, hits = Page(text), []
            for p in wanted:
                passage = known.get(p["key"])
                if passage is None or passage.text != p["passage"]:
                    if len(known) > 2000:
                        known.clear()
                    passage = known[p["key"]] = Passage(p["passage"])
                found = passage.best(page, window, least)
                if found:
                    hits.append(dict(zip(("key", "start", "window", "ratio"), (p["key"], *found))))
            out.append(hits)
        return pd.Series(out)
    # not "deterministic" to the optimizer: it must not be evaluated a second time
    return run.asNondeterministic()
