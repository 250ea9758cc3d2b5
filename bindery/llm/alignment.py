"""Alignment of two tokenizers over the same bytes.

All tokens of both sides are intervals of a text's UTF-8 bytes. They are sorted
by start (``lexsort``); where a start reaches the running maximum of the ends
(``maximum.accumulate``) both sides have ended and a new group begins. Inside a
group the overlapping A and B tokens are expanded into pairs; the links are
those pairs that end together.

Both tokenizers treat a space that follows a character other than white space as
the begin of something new, so a text is cut there into units, every distinct
unit of a batch is encoded and aligned once, and a worker remembers the results.
Texts are tokenized once: a table keeps each document's results and linked id
pairs (4 bytes a link). How often a pair is linked is summed by Spark over that
table; the counts are bounded by the vocabularies, travel to the tasks only
behind a count, and meet the documents in a salted join beyond it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bindery.llm.common import by_size, once, written

PAIRS = 4_000_000  # id pairs (17 bytes each) up to which their counts travel to the tasks
UNITS = 100_000  # units that are looked up in one go
ROW = 200  # units that are encoded as one text
MEMORY = 128 << 20  # bytes of remembered units
SALTS = 32  # copies of the pair counts in the join beyond PAIRS
_ODD = re.compile(r"\s ")  # a space that does not begin a unit
_UNIT = re.compile(r" (?:[^ ]+|(?<=\s) )*")
_PLAIN = re.compile(r"[ -~\nÀ-ÖØ-öø-ÿ]*")  # characters whose classes no Unicode version changes
#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def units_of(text: str) -> list[str]:
    """Pieces of " " + text that begin with a space and end before a space that follows something else than white space."""
    if _ODD.search(" " + text):
        return _UNIT.findall(" " + text)
    return [" " + w for w in text.split(" ")]


def byte_level() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _ranked(path: str, entries: list[bytes]):
    """The tokenizer file as byte ranks, which encode plain texts faster; None where its merges are not in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    vocab = said["model"]["vocab"]
    ids = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in said["model"]["merges"]]
    before = said.get("pre_tokenizer") or {}
    usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and said.get("normalizer") is None
    if not usual or any(i >= j for i, j in zip(ids, ids[1:])):
        return None
    import tiktoken
    ranks = {entries[i]: i for i in vocab.values() if i < 256 + len(ids)}
    return tiktoken.Encoding("ranked", pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(ids) else None


class Aligner:
    """Both tokenizers and what a worker remembers of units."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        chars = byte_level()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(map(chars.__getitem__, entry)) if all(c in chars for c in entry) else entry.encode()
        self.ranked = _ranked(a_path, self.a_bytes)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.kind = np.uint32 if len(self.a_bytes) * len(self.b_bytes) < 2**32 else np.int64
        # a piece with a space inside would span units
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)
        self.width = max(len(self.a_bytes), len(self.b_bytes))
        # an id as text, followed by "," inside a side, "|" after A, ";" after a group, or nothing after the last one of a unit
        self.shown = [f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(self.width)]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[str] = []  # groups as text
        self.table = np.zeros((4096, 4), np.int64)  # n_a, n_b, n_groups, n_links; n_a = -1: bytes differ
        self.codes = np.zeros(16384, self.kind)  # linked id pairs of all units in a row
        self.begin = np.zeros(4097, np.int64)  # where a unit's pairs begin
        self.size = 0

    def cut(self, text: str) -> list[str]:
        return [" " + text] if self.whole else units_of(text)

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, bytes] | None:
        """A and B ids of the units in a row and their bytes; None if those of the ids differ."""
        rows = ["".join(units[i:i + ROW]) for i in range(0, len(units), ROW)]
        if self.ranked is not None and all(map(_PLAIN.fullmatch, rows)):
            a = [i for r in rows for i in self.ranked.encode_ordinary(r)]
        else:
            a = [i for e in self.a.encode_batch_fast(rows, add_special_tokens=False) for i in e.ids]
        # a last blank alone: an empty text would get no space before it
        b = [i for ids in self.b.encode([r[1:] for r in rows], num_threads=1) for i in ids] if rows != [" "] else [self.b.piece_to_id("▁")]
        raw = "".join(rows).encode("utf-8", "surrogatepass")
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64), raw

    def _align(self, units: list[str]) -> None:
        """Remembers units that can stand in a row: a batch in one go, or smaller ones if its bytes differ."""
        found = self._ids(units)
        if found is None:
            if len(units) > 1:
                for at in range(0, len(units), max(1, len(units) // 16)):
                    self._align(units[at:at + max(1, len(units) // 16)])
            else:
                self._add(units, [""], np.empty(0, self.kind), np.array([[-1, 0, 0, 0]]))
            return
        a, b, raw = found
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        a_start, b_start = a_end - self.a_len[a], b_end - self.b_len[b]
        unit_end = np.cumsum([len(u) for u in units] if len(raw) == sum(map(len, units)) else [len(u.encode("utf-8", "surrogatepass")) for u in units])

        start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
        order = np.lexsort((np.repeat([0, 1], [len(a), len(b)]), start))
        reach = np.maximum.accumulate(end[order])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(np.r_[False, start[order][1:] >= reach[:-1]])
        # overlaps inside the groups: B tokens from the first that ends behind an A token's start to the last that starts before its end
        low, high = np.searchsorted(b_end, a_start, side="right"), np.searchsorted(b_start, a_end, side="left")
        x = np.repeat(np.arange(len(a)), high - low)
        y = np.arange(len(x)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[x]
        together = a_end[x] == b_end[y]
        x, y = x[together], y[together]

        n = len(units)
        a_unit, b_unit = np.searchsorted(unit_end, a_end), np.searchsorted(unit_end, b_end)
        unit_of_group = np.empty(int(group.max()) + 1, np.int64)
        unit_of_group[group[:len(a)]] = a_unit
        facts = np.stack([np.bincount(u, minlength=n) for u in (a_unit, b_unit, unit_of_group, a_unit[x])], axis=1)
        # tokens group by group, A before B, each with the mark behind it
        side = np.repeat([0, 1], [len(a), len(b)])
        by = np.lexsort((side, group))
        g, s = group[by], side[by]
        more = np.r_[(g[1:] == g[:-1]) & (s[1:] == s[:-1]), False]
        last = np.r_[unit_of_group[g[1:]] != unit_of_group[g[:-1]], True]
        mark = np.where(more, 0, np.where(s == 0, 1, np.where(last, 3, 2)))
        parts = list(map(self.shown.__getitem__, (mark * self.width + np.concatenate([a, b])[by]).tolist()))
        cuts = np.cumsum(facts[:, 0] + facts[:, 1]).tolist()
        texts = ["".join(parts[i:j]) for i, j in zip([0, *cuts], cuts)]
        self._add(units, texts, (a[x] * len(self.b_bytes) + b[y]).astype(self.kind), facts)

    def _add(self, units: list[str], texts: list[str], codes: np.ndarray, facts: np.ndarray) -> None:
        n, held = len(self.index), int(self.begin[len(self.index)])
        while n + len(units) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.begin = np.concatenate([self.begin, np.zeros(len(self.begin) - 1, np.int64)])
        while held + len(codes) > len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        self.table[n:n + len(units)] = facts
        self.begin[n + 1:n + len(units) + 1] = held + np.cumsum(facts[:, 3])
        self.codes[held:held + len(codes)] = codes
        self.index.update(zip(units, range(n, n + len(units))))
        self.texts += texts
        self.size += 260 * len(units) + 2 * sum(map(len, units)) + sum(map(len, texts)) + 2 * codes.nbytes

    def places(self, units: list[str]) -> np.ndarray:
        """Where each unit is remembered."""
        new = list(set(units).difference(self.index))
        if new and self.size > MEMORY:
            self.forget()
            new = list(set(units))
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            # ends in white space: only a text's end; U+2581 is no space of the text
            apart = [u for u in part if u[-1].isspace() or "▁" in u]
            row = part if not apart else list(set(part).difference(apart))
            for u in apart:
                self._align([u])
            plain = [u for u in row if _PLAIN.fullmatch(u)]
            other = row if not plain else list(set(row).difference(plain))
            for rest in (plain, other):
                if rest:
                    self._align(rest)
        return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))

    def linked(self, place: np.ndarray) -> np.ndarray:
        """Linked pairs of the units at ``place``, in a row."""
        n = self.table[place, 3]
        ends = np.cumsum(n)
        return self.codes[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[place] - (ends - n), n)]


def _slices(aligner: Aligner, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, places of their units), some ``UNITS`` units at a time; a long text comes in several slices."""
    units: list[str] = []
    owners: list[np.ndarray] = []

    def passed() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(owners), aligner.places(units)

    for i, text in enumerate(texts):
        if not text:
            continue
        own = aligner.cut(text)
        for at in range(0, len(own), UNITS):
            part = own[at:at + UNITS]
            units += part
            owners.append(np.full(len(part), i))
            if len(units) >= UNITS:
                yield passed()
                units, owners = [], []
    if units:
        yield passed()


FACTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, groups_sha256, codes (linked id pairs, packed), row; with ``groups`` also the groups. Written."""
    name = f"alignment-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = once(name, lambda: Aligner(a_path, b_path))
        for batch in by_size(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            sums, shas, started = np.zeros((len(texts), 4), np.int64), [hashlib.sha256() for _ in texts], [False] * len(texts)
            whole: list[list[str]] = [[] for _ in texts]
            codes: list[list[bytes]] = [[] for _ in texts]
            good = np.array([bool(t) for t in texts], bool)
            for owner, place in _slices(aligner, texts):
                facts = aligner.table[place]
                good[owner[facts[:, 0] < 0]] = False
                cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
                sums[owner[cuts[:-1]]] += np.add.reduceat(facts, cuts[:-1], axis=0)
                named = list(map(aligner.texts.__getitem__, place.tolist()))
                pairs, ends = aligner.linked(place), np.r_[0, np.cumsum(facts[:, 3])]
                for i, s, e in zip(owner[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                    shown = ";".join(named[s:e])
                    shas[i].update((";" + shown if started[i] else shown).encode())
                    started[i] = True
                    codes[i].append(pairs[ends[s]:ends[e]].tobytes())
                    if groups:
                        whole[i].append(shown)
            sums[~good] = 0
            out = {"id": batch.column("_id")} | {f: pa.array(sums[:, i]) for i, f in enumerate(FACTS[:4])}
            out["groups_sha256"] = pa.array([h.hexdigest() if g else "" for h, g in zip(shas, good)], pa.string())
            out["codes"] = pa.array([b"".join(c) if g else b"" for c, g in zip(codes, good)], pa.binary())
            if groups:
                out["groups"] = pa.array([";".join(w) if g else "" for w, g in zip(whole, good)], pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, " + ", ".join(f"{f} long" for f in FACTS[:4]) + ", groups_sha256 string, codes binary" + (", groups string" if groups else "")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return written(rows.mapInArrow(run, shape).withColumn("row", F.monotonically_increasing_id()), "aligned")


def _sizes(a_path: str, b_path: str) -> tuple[int, type]:
    """Number of B ids and the type of packed pairs."""
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(a_path).get_vocab_size(), sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    return b, np.uint32 if a * b < 2**32 else np.int64


def pair_counts(found: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a, b, n, best): how many links of all texts (``aligned``) hold the two ids, and whether that is the most of any A id for this B id."""
    width, kind = _sizes(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once("pair-counts", dict)
        codes, counts, fresh, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            some, n = np.unique(np.concatenate(fresh), return_counts=True)
            both, which = np.unique(np.concatenate([codes, some.astype(np.int64)]), return_inverse=True)
            return both, np.bincount(which, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (codes // width, codes % width, counts)], names=["a", "b", "n"])

        for batch in batches:
            for packed in batch.column("codes").to_pylist():
                fresh.append(np.frombuffer(packed or b"", kind))
                held += len(fresh[-1])
                if held > 2_000_000:
                    codes, counts = folded()
                    fresh, held = [], 0
                    if len(codes) > 2_000_000:
                        yield rows()
                        codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        if fresh:
            codes, counts = folded()
        yield rows()

    pairs = written(found.select("codes").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "id-pairs")
    top = pairs.groupBy("b").agg(F.max("n").alias("most"))  # a row for each B id at most
    return written(pairs.join(F.broadcast(top), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def _near(found: DataFrame, pairs: DataFrame, names: list[str], width: int, kind: type) -> DataFrame:
    """n_best and count_sum of each row, from counts that travel with the tasks."""
    rows = pairs.toArrow()  # at most ``most_pairs`` rows
    code = (rows["a"].to_numpy() * width + rows["b"].to_numpy()).astype(kind)
    order = np.argsort(code)
    shared = found.sparkSession.sparkContext.broadcast((code[order], rows["n"].to_numpy()[order], rows["best"].to_numpy()[order]))
    del rows, code, order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once("pair-look-up", dict)
        codes, counts, best = shared.value
        for batch in by_size(batches, "codes", 16_000_000):
            packed = batch.column("codes").to_pylist()
            owner = np.repeat(np.arange(len(packed)), [len(p or b"") // np.dtype(kind).itemsize for p in packed])
            code = np.frombuffer(b"".join(p or b"" for p in packed), kind)
            distinct, which = np.unique(code, return_inverse=True)
            at = np.searchsorted(codes, distinct)
            at[at == len(codes)] = 0
            known = codes[at] == distinct if len(codes) else np.zeros(len(distinct), bool)  # a pair that was never counted counts 0
            n, top = (np.where(known, x[at] if len(codes) else 0, 0)[which] for x in (counts, best))
            out = {c: batch.column(c) for c in names}
            out["n_best"] = pa.array(np.bincount(owner[top > 0], minlength=len(packed)).astype(np.int64))
            total = np.zeros(len(packed), np.int64)
            if len(owner):
                begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                total[owner[begins]] = np.add.reduceat(n, begins)
            out["count_sum"] = pa.array(total)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*names).schema.fields)
    return found.select(*names, "codes").mapInArrow(run, f"{shape}, n_best long, count_sum long")


def _far(found: DataFrame, pairs: DataFrame, names: list[str], width: int, kind: type) -> DataFrame:
    """The same where there are more pairs than may travel: links as rows, each hot pair dealt over ``SALTS`` keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once("pair-rows", dict)
        for batch in by_size(batches, "codes", 1_000_000):
            for row, packed in zip(batch.column("row").to_pylist(), batch.column("codes").to_pylist()):
                code, k = np.unique(np.frombuffer(packed or b"", kind).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), row)), pa.array(code // width), pa.array(code % width), pa.array(k)], names=["row", "a", "b", "k"])

    linked = found.select("row", "codes").mapInArrow(run, "row long, a long, b long, k long").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    copies = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sums = linked.join(copies, ["a", "b", "salt"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k"))).alias("n1"), F.sum(F.col("k") * F.col("n")).alias("n2"))
    return found.select("row", *names).join(sums, "row", "left").select(
        *names, F.coalesce("n1", F.lit(0)).cast("long").alias("n_best"), F.coalesce("n2", F.lit(0)).cast("long").alias("count_sum"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", pairs: DataFrame | None = None,
          groups: bool = False, most_pairs: int = PAIRS) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; with ``groups`` also the groups as text.

    A is a byte-level tokenizer file, B a sentencepiece model that puts a space
    before the text; both see the text without special tokens. Groups end where
    tokens of both end; links are the overlapping tokens that end together.
    ``pairs`` are the counts of linked id pairs (default: those of ``docs``).

    A text that is null, empty, or not given back byte for byte by one of the two
    has no tokens: zeros and ''. Texts are read whole, of any length. Null ids stay
    null; repeated rows get equal results and count each time. An empty table
    gives no rows. Other columns are not read.
    """
    found = aligned(docs, a_path, b_path, id_col, text_col, groups)
    pairs = pair_counts(found, a_path, b_path) if pairs is None else pairs
    names = ["id", *FACTS[:4], "groups_sha256", *(["groups"] if groups else [])]
    judged = (_near if pairs.count() <= most_pairs else _far)(found, pairs, names, *_sizes(a_path, b_path))
    return judged.select(F.col("id").alias(id_col), *FACTS, "groups_sha256", *(["groups"] if groups else []))
