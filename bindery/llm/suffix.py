"""Removal of repeated substrings of ``LENGTH`` bytes, by sorting suffixes.

Sorting every suffix of a corpus would move each byte a hundred times. So a
fixed rule picks anchors: of the ``WINDOWS`` places in a window of ``LENGTH``
bytes where ``GRAM`` bytes start, the one with the smallest hash. Equal windows
pick the same place, so only anchors with equal grams can hold equal windows,
and a run of windows with one anchor is one row.

Rows meet by the hash of their gram. Runs that are equal as a whole are settled
by that alone: the first stays, the rest goes. For grams whose runs differ, the
bytes around the anchor are fetched, and the texts right and left of it are
sorted by deep-shallow sorting: multikey quicksort over eight-byte characters
down to ``SHALLOW`` bytes, then a blind trie for each group that still ties. The
common prefixes of neighbours then tell which windows are equal.

Exact copies of whole texts are recognised first and take no part in the sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from bindery.llm.common import broadcast_if_small, grouped, mix, written

LENGTH = 100
GRAM = 32
WINDOWS = LENGTH - GRAM + 1
SHALLOW = 16  # bytes beyond the gram that multikey quicksort sorts
SEGMENT = 1 << 20  # window starts handled at a time
HOT = 100_000  # differing runs of one gram beyond which they are split by the bytes next to the gram
HALF = 34  # a window has so many bytes at least on one side of its gram

_LOW = np.uint64(SEGMENT - 1)
_ONE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64) | np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        n = max(1 << 16, 1 << (n - 1).bit_length())
        base = int(_ONE[which])
        back = pow(base, -1, 1 << 64)
        up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
        up[1:], down[1:] = base, back
        have = _POWERS[which] = (np.cumprod(up), np.cumprod(down))
    return have


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums for the polynomial hash of any slice."""
    up, _ = _powers(len(data) + 1, which)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])])


def _slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    _, down = _powers(len(sums), which)
    return mix((sums[end] - sums[start]) * down[start])


def runs(data: bytes) -> tuple[np.ndarray, ...]:
    """(gram hash, run hash, first window, last window, anchor) of the runs of windows of a text; none if it is too short."""
    parts = []
    for at in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT - LENGTH):
        piece = np.frombuffer(data[at:at + SEGMENT - 1], np.uint8)
        if len(piece) < LENGTH:
            break
        sums = _sums(piece, 0)
        starts = np.arange(len(piece) - GRAM + 1)
        gram = _slice_hash(sums, starts, starts + GRAM, 0)
        low = (gram & ~_LOW) | starts.astype(np.uint64)  # ties go to the first place
        for step in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[:-step], low[step:])
        rest = WINDOWS - 64
        low = np.minimum(low[:-rest], low[rest:]) if rest else low
        anchor = (low & _LOW).astype(np.int64)  # of the window at each start
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[first[1:], len(anchor)] - 1
        anchor = anchor[first]
        whole = _slice_hash(_sums(piece, 1), first, last + LENGTH, 1)
        whole = mix(whole ^ ((last - first) * 128 + (anchor - first)).astype(np.uint64))
        parts.append((gram[anchor], whole, first + at, last + at, anchor + at))
        if at + SEGMENT - 1 >= len(data):
            break
    if not parts:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts))


# ---- deep-shallow sorting

def _lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] equal, a[:high] not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class _Branch:
    """Inner node of a blind trie: only the depth where its strings part, and a child for each byte there (-1: end)."""
    __slots__ = ("depth", "children", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.leaf, self.children = depth, leaf, {}


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order of the strings and the common prefix of each with the one before it (0 for the first)."""
    if len(strings) == 1:
        return [0], [0]

    def byte(i: int, depth: int) -> int:
        return strings[i][depth] if depth < len(strings[i]) else -1

    same: dict[int, list[int]] = {}  # equal strings behind the first of them
    root: _Branch | int = 0
    for i in range(1, len(strings)):
        node = root
        while isinstance(node, _Branch):  # blindly down
            child = node.children.get(byte(i, node.depth))
            node = node.leaf if child is None else child
        common = _lcp(strings[i], strings[node])
        if common == len(strings[i]) == len(strings[node]):
            same.setdefault(node, []).append(i)
            continue
        above, node = None, root
        while isinstance(node, _Branch) and node.depth < common:
            above, node = node, node.children[byte(i, node.depth)]
        if isinstance(node, _Branch) and node.depth == common:
            node.children[byte(i, common)] = i
            continue
        some = node.leaf if isinstance(node, _Branch) else node
        new = _Branch(common, some)
        new.children = {byte(some, common): node, byte(i, common): i}
        if above is None:
            root = new
        else:
            above.children[byte(i, above.depth)] = new
    order, lcp, open_ = [], [], [(root, 0)]
    while open_:
        node, shared = open_.pop()
        if isinstance(node, _Branch):
            for k, key in enumerate(sorted(node.children, reverse=True)):
                open_.append((node.children[key], node.depth if k < len(node.children) - 1 else shared))
            continue
        for j, i in enumerate([node, *same.get(node, [])]):
            order.append(i)
            lcp.append(len(strings[i]) if j else shared)
    return order, lcp


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts by (group, string): the order, and the common prefix of each with the one before (-1 where the group changes).

    Multikey quicksort: all open groups are parted at once by their next eight
    bytes, down to ``SHALLOW``; what still ties goes to blind tries.
    """
    n = len(strings)
    head = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), np.uint8).reshape(n, SHALLOW)
    size = np.minimum(np.array([len(s) for s in strings]), SHALLOW)
    order = np.argsort(group, kind="stable")
    tied = np.r_[False, group[order][1:] == group[order][:-1]]
    lcp = np.where(tied, 0, -1)
    for depth in range(0, SHALLOW, 8):
        segment = np.cumsum(~tied)
        words = head[:, depth:depth + 8].copy().view(">u8").ravel().astype(np.uint64)
        known = np.clip(size - depth, 0, 8)  # a string that ends sorts before one that goes on with zeros
        order_in = np.lexsort((known[order], words[order], segment))
        order = order[order_in]
        equal = (words[order][1:] == words[order][:-1]) & (known[order][1:] == known[order][:-1])
        parted = tied & np.r_[False, ~equal]
        at = np.flatnonzero(parted)
        if len(at):
            a, b = order[at], order[at - 1]
            differ = head[a, depth:depth + 8] != head[b, depth:depth + 8]
            shared = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
            lcp[at] = depth + np.minimum(shared, np.minimum(known[a], known[b]))
        tied &= np.r_[False, equal]
    starts = np.flatnonzero(~tied)
    ends = np.r_[starts[1:], n]
    for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        mine = order[s:e]
        inner, common = blind_trie([strings[i] for i in mine])
        order[s:e] = mine[inner]
        lcp[s + 1:e] = common[1:]
    return order, lcp


def repeated_windows(group: np.ndarray, contexts: list[bytes], anchor: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which windows occur in an earlier context of the group: a flag for each context and place of the gram in the window.

    Context i has its gram at ``anchor[i]`` and windows that start at 0 to
    ``last[i]``; contexts of a group come in the order of their places in the corpus.
    """
    n = len(contexts)
    right, right_lcp = deep_shallow([c[a + GRAM:] for c, a in zip(contexts, anchor)], group)
    left, left_lcp = deep_shallow([c[:a][::-1] for c, a in zip(contexts, anchor)], group)
    found = np.zeros((n, WINDOWS), bool)
    class_l, class_r = np.empty(n, np.int64), np.empty(n, np.int64)
    for place in range(WINDOWS):
        valid = np.flatnonzero((place <= anchor) & (place >= anchor - last))
        if len(valid) < 2:
            continue
        class_l[left] = np.cumsum(left_lcp < place)
        class_r[right] = np.cumsum(right_lcp < WINDOWS - 1 - place)
        both = class_l[valid] * (n + 1) + class_r[valid]
        order = np.argsort(both, kind="stable")
        again = np.r_[False, both[order][1:] == both[order][:-1]]
        found[valid[order[again]], place] = True
    return found


# ---- jobs

ROWS = "gram long, whole long, doc long, twin long, first long, span int, anchor int, again boolean"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of runs. A run that a place before it in the same batch equals is settled here, and dealt by its place."""
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part, out = batch.iloc[at:at + 2000], []
            for doc, twin, text in zip(part["doc"], part["twin"], part["text"]):
                gram, whole, first, last, anchor = runs(text.encode("utf-8", "surrogatepass"))
                if len(gram):
                    out.append(np.array([gram.view(np.int64), whole.view(np.int64), np.full(len(gram), doc), np.full(len(gram), twin), first, last - first, anchor - first]))
            if not out:
                continue
            rows = np.concatenate(out, axis=1)
            rows = rows[:, np.lexsort(rows[4::-1])]
            rows = rows[:, np.r_[True, (rows[:5, 1:] != rows[:5, :-1]).any(axis=0)]]  # repeated rows once
            again = np.r_[False, (rows[:2, 1:] == rows[:2, :-1]).all(axis=0)]
            rows[0, again] = mix(mix(rows[2, again].view(np.uint64)) ^ rows[4, again].view(np.uint64)).view(np.int64)
            found = pd.DataFrame(rows.T, columns=["gram", "whole", "doc", "twin", "first", "span", "anchor"])
            yield found.astype({"span": np.int32, "anchor": np.int32}).assign(again=again)


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by (gram, whole, place): later rows of an equal run, and the first rows of grams whose runs differ.

    Only the last row, and the first of its gram, are kept from batch to batch.
    """
    names_of = ["gram", "whole", "doc", "twin", "first"]
    previous = opening = None  # its (gram, whole, place); the first row of the gram as long as no other run of it was seen
    for batch in batches:
        done = batch["again"].to_numpy()
        if done.any():
            yield batch[done].drop(columns="whole")
            batch = batch[~done]
        if batch.empty:
            continue
        names = batch[names_of].to_numpy()
        repeat = np.r_[previous is not None and (names[0] == previous).all(), (names[1:] == names[:-1]).all(axis=1)]  # of a repeated row
        batch, names = batch[~repeat], names[~repeat]
        if batch.empty:
            continue
        gram, whole = names[:, 0], names[:, 1]
        same_gram = np.r_[previous is not None and gram[0] == previous[0], gram[1:] == gram[:-1]]
        same_run = same_gram & np.r_[previous is not None and whole[0] == previous[1], whole[1:] == whole[:-1]]
        differs = same_gram & ~same_run  # first row of a second or later run of its gram
        again = batch[same_run].assign(again=True)
        group = np.cumsum(~same_gram)
        mixed = np.zeros(len(batch), bool)
        has = np.zeros(group[-1] + 1, bool)
        has[group[differs]] = True
        starts = np.flatnonzero(~same_gram)
        mixed[starts] = has[group[starts]]
        variants = batch[mixed | differs].assign(again=False)
        if opening is not None and has[0] and same_gram[0]:
            variants = pd.concat([opening, variants], ignore_index=True)
            opening = None
        if len(starts):
            s = starts[-1]
            opening = None if has[group[s]] else batch.iloc[s:s + 1].assign(again=False)
        previous = names[-1]
        out = pd.concat([again, variants], ignore_index=True).drop(columns="whole")
        if len(out):
            yield out


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
        rows = [(g, d, w, x["first"], x["span"], x["anchor"], t[x["first"]:x["first"] + x["span"] + LENGTH])
                for d, w, t, v in zip(batch["doc"], batch["twin"], texts, batch["variants"]) for x in v for g in (x["gram"],)]
        for at in range(0, len(rows), 20_000):
            yield pd.DataFrame(rows[at:at + 20_000], columns=["gram", "doc", "twin", "first", "span", "anchor", "bytes"])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in grouped(batches, ["gram", "part"]):
        group = np.cumsum(np.r_[True, (frame[["gram", "part"]].to_numpy()[1:] != frame[["gram", "part"]].to_numpy()[:-1]).any(axis=1)])
        own = [xxhash.xxh3_64_intdigest(b[a:a + GRAM]) for b, a in zip(frame["bytes"], frame["anchor"])]
        _, group = np.unique(np.array([group, own], np.uint64).T, axis=0, return_inverse=True)  # grams that only share their hash stay apart
        found = repeated_windows(group.ravel(), list(frame["bytes"]), frame["anchor"].to_numpy(np.int64), frame["span"].to_numpy(np.int64))
        # neighbouring places of one context are one interval
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        first = frame["first"].to_numpy()[row] + frame["anchor"].to_numpy()[row]
        if len(row):
            yield pd.DataFrame({"doc": frame["doc"].to_numpy()[row], "twin": frame["twin"].to_numpy()[row],
                                "start": first - (high - 1), "length": LENGTH + (high - 1) - low})


def _cut(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
    """Cuts intervals, packed as start * 2^16 + length, out of a text's bytes."""
    out = []
    for t, packed in zip(text, gone):
        data, x = t.encode("utf-8", "surrogatepass"), np.sort(np.asarray(packed, np.int64))
        start, end = x >> 16, (x >> 16) + (x & 0xFFFF)
        reach = np.maximum.accumulate(end)
        opens = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
        spans = list(zip(start[opens].tolist(), reach[np.r_[opens[1:], len(x)] - 1].tolist()))
        kept, at = hashlib.sha256(), 0
        for s, e in spans:
            kept.update(data[at:s])
            at = e
        kept.update(data[at:])
        out.append((sum(e - s for s, e in spans), len(spans), kept.hexdigest()))
    return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a string of ``LENGTH`` bytes that also starts earlier
    (smaller id, or same text and smaller start) is removed; strings are judged
    on the input. Texts shorter than that keep all bytes; null texts are empty.
    Repeated rows (same id and text) are one text and get one result; rows of one
    id with different texts come in the order of a hash of the text; a null id
    comes after all others. An empty table gives no rows. Other columns are not
    read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"),
                       F.xxhash64(text).alias("twin"), text.alias("text"))
    facts = written(rows.select("id", "doc", "twin", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha")), "text-facts")

    # whole copies: the smallest (doc, twin) of a text stays
    long_ = facts.filter(F.col("n") >= LENGTH)
    copies = long_.groupBy("sha").agg(F.min(F.struct("doc", "twin")).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("sha", "f.*")
    copies = written(copies.withColumnsRenamed({"doc": "first_doc", "twin": "first_twin"}), "copied-texts")
    later = long_.join(copies, "sha").filter("doc != first_doc or twin != first_twin").select("doc", "twin").distinct()
    later = written(later, "later-copies")
    firsts = rows.filter(F.octet_length("text") >= LENGTH).join(broadcast_if_small(later), ["doc", "twin"], "left_anti").select("doc", "twin", "text")

    found = firsts.mapInPandas(_runs, ROWS).repartition("gram").sortWithinPartitions("gram", "whole", "doc", "twin", "first")
    settled = written(found.mapInPandas(_settle, ROWS.replace("whole long, ", "")), "runs")
    again = settled.filter("again").select("doc", "twin", F.col("first").alias("start"), (F.col("span") + LENGTH).cast("long").alias("length"))

    # grams whose runs differ: the bytes around the anchor
    variants = settled.filter("not again").distinct()
    of_doc = written(variants.groupBy("doc", "twin").agg(F.collect_list(F.struct("gram", "first", "span", "anchor")).alias("variants")), "variants")
    needed = firsts.join(broadcast_if_small(of_doc.select("doc", "twin")), ["doc", "twin"], "left_semi").dropDuplicates(["doc", "twin"])
    contexts = needed.join(of_doc, ["doc", "twin"]).mapInPandas(_contexts, "gram long, doc long, twin long, first long, span int, anchor int, bytes binary")
    hot = written(variants.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("gram", F.lit(True).alias("hot")), "hot-grams")
    # at most one hot gram in HOT rows; its windows are split by the bytes on the side that has HALF of them
    contexts = contexts.join(F.broadcast(hot), "gram", "left")
    left = F.when(F.col("anchor") >= HALF, F.xxhash64(F.lit(1), F.expr(f"substring(bytes, anchor - {HALF} + 1, {HALF})")))
    right = F.xxhash64(F.lit(2), F.expr(f"substring(bytes, anchor + {GRAM} + 1, {HALF})"))
    part = F.when(F.col("hot"), F.array_compact(F.array(left, right))).otherwise(F.array(F.lit(0).cast("long")))
    contexts = contexts.withColumn("part", F.explode(part)).drop("hot").repartition("gram", "part").sortWithinPartitions("gram", "part", "doc", "twin", "first")
    windows = contexts.mapInPandas(_compare, "doc long, twin long, start long, length long")

    cut_out = F.pandas_udf(_cut, "n_removed long, n_spans long, kept_sha256 string")
    gone = written(again.union(windows).groupBy("doc", "twin").agg(F.collect_set(F.col("start") * 65536 + F.col("length")).alias("gone")), "removed")
    touched = firsts.join(broadcast_if_small(gone.select("doc", "twin")), ["doc", "twin"], "left_semi").dropDuplicates(["doc", "twin"])
    cut = touched.join(gone, ["doc", "twin"]).select("doc", "twin", cut_out("text", "gone").alias("c")).select("doc", "twin", "c.*")
    whole = later.join(facts, ["doc", "twin"]).select("doc", "twin", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
                                                       F.sha2(F.lit(""), 256).alias("kept_sha256")).distinct()
    result = written(cut.union(whole), "cut-texts")
    none = F.lit(0).cast("long")
    return facts.join(result, ["doc", "twin"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_bytes"), F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
