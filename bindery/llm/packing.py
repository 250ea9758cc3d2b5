"""Packing tokenised examples into training sequences by vector bin packing.

An example is a vector of three demands: tokens, segments (one per piece) and
loss-bearing tokens. Open sequences have what is left of three limits. The next
example is the one whose demand has the largest dot product with what the
sequence has left, both in shares of the limits, so a sequence rich in tokens
but short of segments draws long examples and the reverse. Where nothing fits
whole, an example is cut at the limit.

Each task packs the documents of its own partition while it streams over them:
nothing is shuffled, a task holds a bounded window of examples, and a lost task
makes the same sequences again. What is left at a task's end is cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from bindery.llm.alignment import byte_level
from bindery.llm.common import once

WINDOW = 256  # examples that wait for a sequence at a time
MEMORY = 32 << 20  # bytes of words and ids that a worker remembers

_SUFFIX = "</w>"  # of the last entry of a word
_END = "\0"  # stands for it among bytes
_PLAIN = re.compile(r"[!-~\nÀ-ÖØ-öø-ÿ]*")  # characters whose classes and lower case no Unicode version changes, composed ones only
#: The kind of tokenizer (normalizer, pre-tokenizer, post-processor) that is also written out here for plain words in lower case.
_KIND = ({"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
         {"type": "Sequence", "pretokenizers": [
             {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
             {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}, None)
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+|\n")

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, "
          "loss_tokens long, padded_to long")


class _Ranked:
    """A byte-pair encoder of plain pieces that end with ``_END``, and the id of a line break."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken
        self.encode_ordinary = tiktoken.Encoding("ranked-words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.line = ranks[f"\n{_END}".encode()]


def _ranked(path: str) -> _Ranked | None:
    """The tokenizer file as byte ranks, which encode plain words faster; None where it is of another kind.

    The end of a word is a byte of its own, which first joins the byte before it.
    That needs bytes, last bytes and merges to have their ids in this order.
    """
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model = said["model"]
    if (said.get("normalizer"), said.get("pre_tokenizer"), said.get("post_processor")) != _KIND or model.get("type") != "BPE" \
            or model.get("end_of_word_suffix") != _SUFFIX or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges")):
        return None
    if any(not a["content"].startswith("<|") for a in said.get("added_tokens") or ()):
        return None
    vocab, chars = model["vocab"], byte_level()
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if merged != list(range(512, 512 + len(merged))) or any(vocab.get(c, 256) > 255 or not 256 <= vocab.get(c + _SUFFIX, 0) < 512 for c in chars):
        return None
    ranks = {}
    for entry, i in vocab.items():
        if i < 512 + len(merged):
            last = i >= 256 and entry.endswith(_SUFFIX)
            ranks[bytes(map(chars.__getitem__, entry.removesuffix(_SUFFIX) if last else entry)) + _END.encode() * last] = i
    return _Ranked(ranks) if len(ranks) == 512 + len(merged) else None


class _Words:
    """A tokenizer and the ids of words that it has met."""

    def __init__(self, path: str):
        self.path = path
        self.ranked = _ranked(path)
        self.ids: dict[str, bytes] = {}
        self.size = 0

    @cached_property
    def tok(self):
        """Only loaded where words ask for it: it takes some 30 MB."""
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def encoded(self, words: list[str]) -> list[bytes]:
        """Ids of each word (no token spans white space), encoded as one text of a word a line."""
        text = "\n".join(words)
        if self.ranked is not None:
            if _PLAIN.fullmatch(text) and "<|" not in text:
                return self._plain(text, len(words))
            odd = [w for w in words if not _PLAIN.fullmatch(w) or "<|" in w]
            if 0 < len(odd) < len(words):
                apart = set(odd)
                plain = [w for w in words if w not in apart]
                found = dict(zip(plain, self._plain("\n".join(plain), len(plain))))
                found.update(zip(odd, self._other(odd)))
                return [found[w] for w in words]
        return self._other(words)

    def _plain(self, text: str, n: int) -> list[bytes]:
        pieces = _PIECES.findall(text.lower())
        if not pieces:
            return [b""] * n
        ids = np.array(self.ranked.encode_ordinary(_END.join(pieces) + _END), "<u4")
        line = ids == self.ranked.line
        ends = np.append(np.flatnonzero(line), len(ids)) - np.arange(n)
        raw = ids[~line].tobytes()
        ends = (ends * 4).tolist()
        return [raw[a:b] for a, b in zip([0] + ends[:-1], ends)]

    def _other(self, words: list[str]) -> list[bytes]:
        found = self.tok.encode("\n".join(words), add_special_tokens=False)
        lines = np.cumsum([0] + [len(w) + 1 for w in words])
        owner = np.searchsorted(lines, np.array([start for start, _ in found.offsets], np.int64), side="right") - 1
        ends = np.cumsum(np.bincount(owner, minlength=len(words))) * 4
        raw = np.array(found.ids, "<u4").tobytes()
        return [raw[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]


def token_ids(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of whole texts. Each distinct word is encoded once; a worker remembers short ones, ``MEMORY`` bytes in all."""
    known = once(("packing", path), lambda: _Words(path))
    words = [(t or "").replace("\n", " ").split(" ") for t in texts]
    new = list(set().union(*words).difference(known.ids))
    passing: list[str] = []  # words that are known for these texts only
    for at in range(0, len(new), 5000):
        part = new[at:at + 5000]
        for w, ids in zip(part, known.encoded(part)):
            known.ids[w] = ids
            if len(w) <= 64 and known.size < MEMORY:
                known.size += 190 + len(w) + len(ids)  # with what the two objects and their entry take
            else:
                passing.append(w)
    find = known.ids.__getitem__
    out = [np.frombuffer(b"".join(map(find, ws)), "<u4") for ws in words]
    for w in passing:
        del known.ids[w]
    return out


class _Packer:
    """The open sequence of a task and the examples that wait for one."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.limit = (max_tokens, max_segments, max_loss)
        self.base = TaskContext.get().partitionId() << 40
        self.made = 0
        self.waiting: list[tuple] = []  # (doc, ids, start, doc_tokens, loss mask)
        self.demand = np.zeros((WINDOW + 2, 3))  # of each that waits, in the same order
        self.rows: list[tuple] = []
        self.open()

    def open(self) -> None:
        self.room = list(self.limit)
        self.pieces: list[tuple] = []

    def close(self, padded_to: int | None = None) -> None:
        offset, name = 0, self.base + self.made
        used = sum(len(p[1]) for p in self.pieces)
        for doc, ids, start, total, loss in self.pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, name, offset,
                              int(loss.sum()), padded_to or (used if used & (used - 1) == 0 else self.limit[0])))
            offset += len(ids)
        self.made += 1
        self.open()

    def put(self, item: tuple) -> None:
        self.pieces.append(item)
        self.room[0] -= len(item[1])
        self.room[1] -= 1
        self.room[2] -= int(item[4].sum())
        if min(self.room) <= 0:
            self.close()

    def wait(self, item: tuple) -> None:
        self.demand[len(self.waiting)] = len(item[1]), 1, item[4].sum()
        self.waiting.append(item)

    def take(self, i: int) -> tuple:
        """Removes one that waits; the last takes its place."""
        item, last = self.waiting[i], self.waiting.pop()
        if i < len(self.waiting):
            self.waiting[i] = last
            self.demand[i] = self.demand[len(self.waiting)]
        return item

    @staticmethod
    def cut(item: tuple, at: int) -> tuple[tuple, tuple]:
        doc, ids, start, total, loss = item
        return (doc, ids[:at], start, total, loss[:at]), (doc, ids[at:], start + at, total, loss[at:])

    def head(self, item: tuple, most: int) -> int:
        """Longest start of the example that the open sequence has room for."""
        most = min(most, len(item[1]))
        loss = np.cumsum(item[4][:most])
        return int(np.searchsorted(loss, self.room[2], side="right"))

    def place(self) -> None:
        """Takes the waiting example of the largest dot product that fits, or cuts the best one at the limit."""
        demand, room = self.demand[:len(self.waiting)], np.array(self.room, float)
        score = demand @ (room / self.limits / self.limits)
        fits = (demand <= room).all(axis=1)
        if fits.any():
            self.put(self.take(int(np.argmax(np.where(fits, score, -1)))))
            return
        item = self.take(int(np.argmax(score)))
        at = self.head(item, self.room[0])
        if at == 0:  # no loss-bearing token more, and this one starts with one
            self.wait(item)
            self.close()
            return
        first, rest = self.cut(item, at)
        self.wait(rest)
        self.put(first)

    def add(self, item: tuple) -> None:
        while len(item[1]) >= self.limit[0] and not self.pieces and self.head(item, self.limit[0]) == self.limit[0]:
            first, item = self.cut(item, self.limit[0])  # a full sequence of its own
            self.put(first)
        if len(item[1]):
            self.wait(item)
        while len(self.waiting) > WINDOW:
            self.place()

    def finish(self) -> None:
        while self.waiting:
            self.place()
        tail, self.pieces = self.pieces, []
        left = sum(len(p[1]) for p in tail)
        while left:
            size = 1 << (left.bit_length() - 1)
            left, need = left - size, size
            while need:
                if len(tail[0][1]) > need:
                    first, tail[0] = self.cut(tail[0], need)
                else:
                    first = tail.pop(0)
                need -= len(first[1])
                self.pieces.append(first)
            self.close(size)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None,
         max_tokens: int = 4096, max_segments: int = 128, max_loss: int | None = None, end_id: int = 2) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, padded_to.

    A document is the ids of ``prompt_col`` (no loss, left out if None), those of
    ``text_col`` and ``end_id``. Every id lies in exactly one piece; a sequence
    has at most ``max_tokens`` ids, ``max_segments`` pieces and ``max_loss``
    loss-bearing ids (default: no limit of its own). ``tokenizer`` is the path
    of a tokenizer file that every worker has.

    Null texts are empty, so their document is one end id; a null id stays null
    on its pieces; repeated rows are packed once each. An empty table gives no
    pieces. Other columns are not read.
    """
    loss_limit = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, loss_limit) < 1:
        raise ValueError("limits must be positive")
    prompt = F.col(prompt_col) if prompt_col else F.lit(None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, names = _Packer(max_tokens, max_segments, loss_limit), [c.split()[0].strip("`") for c in PIECES.split(", ")]

        def rows() -> pd.DataFrame:
            out = pd.DataFrame(packer.rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            packer.rows = []
            return out

        for batch in batches:
            for at in range(0, len(batch), 200):  # so many texts tokenised at a time
                part = batch.iloc[at:at + 200]
                bodies = token_ids(list(part["_text"]), tokenizer)
                prompts = token_ids(list(part["_prompt"]), tokenizer)
                for doc, body, ask in zip(part["_id"], bodies, prompts):
                    ids = np.concatenate([ask, body, np.array([end_id], np.uint32)])
                    loss = np.ones(len(ids), bool)
                    loss[:len(ask)] = False
                    packer.add((None if pd.isna(doc) else int(doc), ids, 0, len(ids), loss))
                if len(packer.rows) > 10_000:
                    yield rows()
        packer.finish()
        yield rows()

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"),
                       prompt.cast("string").alias("_prompt")).mapInPandas(run, PIECES)
