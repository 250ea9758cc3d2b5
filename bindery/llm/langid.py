"""Language identification of whole texts, mixed ones included.

A word is scored against every language by its letter n-grams (naive Bayes over
hashed n-grams, so the model has a fixed size a language). Only languages that
are written in the word's script compete. A Viterbi pass over the words of a
text, in which a change of language costs ``SWITCH``, labels its spans; the
text's language is the one with most letters, its score that share of the
letters.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from bindery.llm.common import mix, once

BITS = 16  # hashed n-grams a language
SWITCH = 12.0  # natural-log cost of a change of language
HELD_OUT = 2  # remainder of crc32(id) mod 4 that is never learned from
WORDS = 100_000  # distinct words beyond which a worker forgets their scores, between groups of texts
CELLS = 300_000  # words times texts that go through Viterbi together
CHARS = 1_000_000  # characters of texts that are labelled together
SCORED = 4000  # new words that are scored together

#: First code points of script ranges, in order, with the script from there on.
SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
           (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
           (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
           (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"),
           (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB50, "arabic"), (0xFE00, "other"),
           (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other")]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_CODES = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_WORD = regex.compile(r"\p{L}{1,64}")


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed letter n-grams (2 to 4, with word ends) of lower-cased words, the word of each, and each word's script.

    A word's script is that of most of its letters; ties go to the first letter's.
    """
    low = [f"<{w.lower()}>" for w in words]
    lengths = np.array([len(w) for w in low])
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.repeat(np.arange(len(low)), lengths)
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grams, owners, acc = [], [], codes.astype(np.uint64)
    for n in (2, 3, 4):  # acc[i]: the n letters from place i
        acc = acc[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:].astype(np.uint64)
        whole = inside[n - 1:] >= n - 1
        grams.append((mix(acc[whole]) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(word[n - 1:][whole])
    letter = (inside > 0) & (inside < np.repeat(lengths, lengths) - 1)
    kinds = _CODES[np.searchsorted(_STARTS, codes, side="right") - 1]
    counts = np.bincount(word[letter] * len(_NAMES) + kinds[letter], minlength=len(low) * len(_NAMES)).reshape(len(low), -1) * 2
    first = np.cumsum(lengths) - lengths + 1
    counts[np.arange(len(low)), kinds[first]] += 1
    return np.concatenate(grams), np.concatenate(owners), counts.argmax(axis=1)


@dataclass
class Model:
    """Languages, log-probabilities (n-gram x language), and the scripts each language is written in."""
    langs: list[str]
    logp: np.ndarray
    scripts: np.ndarray
    index: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.forget()

    def _score(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in every language; languages of other scripts are far behind."""
        grams, owner, script = features(words)
        score = np.stack([np.bincount(owner, weights=self.logp[grams, i], minlength=len(words)) for i in range(len(self.langs))], axis=1)
        allowed = self.scripts[script]
        score = np.where(allowed, score, score.min(axis=1, keepdims=True) - 1000.0)
        score[~allowed.any(axis=1)] = 0.0
        return score - score.max(axis=1, keepdims=True)

    def forget(self) -> None:
        self.index.clear()
        self.waiting, self.table, self.letters = [], np.zeros((4096, len(self.langs)), np.float32), np.zeros(4096, np.uint8)

    def numbers(self, words: list[str]) -> np.ndarray:
        """A number for each word, the same for equal ones; ``scored`` must be called before the table is read."""
        for w in set(words).difference(self.index):
            self.index[w] = len(self.index)
            self.waiting.append(w)
            if len(self.waiting) == SCORED:
                self.scored()
        return np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))

    def scored(self) -> None:
        """Scores the words that came since the last call: a row of ``table`` and the letters of each."""
        new, known = self.waiting, len(self.index) - len(self.waiting)
        if not new:
            return
        if len(self.index) > len(self.table):
            size = max(len(self.index), len(self.table) * 3 // 2)
            self.table = np.concatenate([self.table[:known], np.zeros((size - known, len(self.langs)), np.float32)])
            self.letters = np.concatenate([self.letters[:known], np.zeros(size - known, np.uint8)])
        self.table[known:known + len(new)] = self._score(new)
        self.letters[known:known + len(new)] = [len(w) for w in new]
        self.waiting = []


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts n-grams of all texts with a language outside the held-out quarter.

    Each task counts the distinct words of its texts, then their n-grams; what is
    shuffled is at most 2^``BITS`` counts a language, script and task, and the
    driver gets that many a language. Nothing to learn from gives an empty model.
    """
    train = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)) \
        .select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once("language-counts", dict)
        grams: dict[str, np.ndarray] = {}
        letters: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def fold() -> None:
            for lang, seen in words.items():
                g = grams.setdefault(lang, np.zeros(1 << BITS, np.int64))
                s = letters.setdefault(lang, np.zeros(len(_NAMES), np.int64))
                distinct, n = list(seen), np.fromiter(seen.values(), np.float64, len(seen))
                for at in range(0, len(distinct), SCORED):
                    part, many = distinct[at:at + SCORED], n[at:at + SCORED]
                    grams_, owner, script = features(part)
                    g += np.bincount(grams_, weights=many[owner], minlength=1 << BITS).astype(np.int64)
                    s += np.bincount(script, weights=many * np.array([len(w) for w in part]), minlength=len(_NAMES)).astype(np.int64)
            words.clear()

        for batch in batches:
            for i, (lang, text) in enumerate(zip(batch["_lang"], batch["_text"])):
                words.setdefault(lang, Counter()).update(_WORD.findall(text))
                if i % 500 == 0 and sum(map(len, words.values())) > 150_000:
                    fold()
        fold()
        for lang, g in grams.items():
            at = np.flatnonzero(g)
            yield pd.DataFrame({"lang": lang, "kind": 0, "at": at, "n": g[at]})
            at = np.flatnonzero(letters[lang])
            yield pd.DataFrame({"lang": lang, "kind": 1, "at": at, "n": letters[lang][at]})

    counts = train.mapInPandas(count, "lang string, kind int, at long, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    logp = np.full((1 << BITS, len(langs)), 0.5)
    scripts = np.zeros((len(_NAMES), len(langs)), bool)
    for i, lang in enumerate(langs):
        mine = counts[counts["lang"] == lang]
        g, s = mine[mine["kind"] == 0], mine[mine["kind"] == 1]
        np.add.at(logp[:, i], g["at"].to_numpy(np.int64), g["n"].to_numpy(np.float64))
        share = np.zeros(len(_NAMES))
        share[s["at"].to_numpy(np.int64)] = s["n"].to_numpy(np.float64)
        scripts[:, i] = share >= 0.01 * max(share.sum(), 1)
    return Model(list(langs), np.log(logp / logp.sum(axis=0)).astype(np.float32) if langs else logp, scripts)


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Best language of every word for each text (words x languages); all texts advance together, the longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    paths: list[np.ndarray] = [np.empty(0, np.int8)] * len(scores)
    at = 0
    while at < len(order) and len(scores[order[at]]):
        longest = len(scores[order[at]])
        group = [i for i in order[at:at + max(1, CELLS // longest)] if len(scores[i])]
        at += len(group)
        lengths = np.array([len(scores[i]) for i in group])
        n_lang = scores[group[0]].shape[1]
        cube = np.zeros((longest, len(group), n_lang), np.float32)
        for j, i in enumerate(group):
            cube[:lengths[j], j] = scores[i]
        came = np.zeros((longest, len(group), n_lang), np.int8)
        best = cube[0].astype(np.float64)
        stay = np.arange(n_lang, dtype=np.int8)
        alive = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts with a word at each step
        for t in range(1, longest):
            k = alive[t]
            now = best[:k]
            top = now.argmax(axis=1)
            jump = now[np.arange(k), top] - switch
            change = jump[:, None] > now
            came[t, :k] = np.where(change, top[:, None], stay)
            best[:k] = np.where(change, jump[:, None], now) + cube[t, :k]
        path = np.zeros((longest, len(group)), np.int8)
        state = best.argmax(axis=1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            k = alive[t]
            path[t, :k] = state[:k]
            state[:k] = came[t, np.arange(k), state[:k]]
        for j, i in enumerate(group):
            paths[i] = path[:lengths[j], j]
    return paths


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, carry: bool = False) -> DataFrame:
    """Per row: id, lang_pred, score; with ``spans`` also the spans (lang, first word, words, letters); with ``carry`` all columns first.

    Words are runs of letters of the whole text (longer runs in pieces of 64). ``und`` and a score of 0 stand
    for a text that is null or has no letter, or a model without languages. Ties
    go to the first language in alphabetical order. Null ids stay null; repeated
    rows get the same answer. Only id and text are read unless ``carry`` is set.
    The model has a fixed size a language and travels with the tasks.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.scripts)), uuid.uuid4().hex

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = once(name, lambda: Model(*shared.value))
        for batch in texts:
            pred, score, found = [], [], []
            lengths = np.cumsum(batch.map(lambda t: len(t or "")).to_numpy(np.int64)) // CHARS
            cuts = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1], True]).tolist() if len(batch) else [0]
            for at, end in zip(cuts, cuts[1:]):
                if len(m.index) > WORDS:
                    m.forget()
                # a text's words are held as strings one text at a time
                words = [m.numbers(_WORD.findall(t or "") if m.langs else []) for t in batch.iloc[at:end]]
                m.scored()
                paths = viterbi([m.table[ws] for ws in words])
                for ws, path in zip(words, paths):
                    if not len(ws):
                        pred.append("und")
                        score.append(0.0)
                        found.append([])
                        continue
                    letters = m.letters[ws].astype(np.int64)
                    share = np.bincount(path, weights=letters, minlength=len(m.langs))
                    pred.append(m.langs[int(share.argmax())])
                    score.append(float(share.max() / share.sum()))
                    starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]]) if spans else []
                    ends = [*starts[1:], len(path)] if spans else []
                    found.append([{"lang": m.langs[path[s]], "first_word": int(s), "words": int(e - s), "letters": int(letters[s:e].sum())} for s, e in zip(starts, ends)])
            out = pd.DataFrame({"lang_pred": pred, "score": score})
            if spans:
                out["spans"] = found
            yield out

    shape = "lang_pred string, score double" + (", spans array<struct<lang string, first_word int, words int, letters long>>" if spans else "")
    # not "deterministic" to the optimizer: a filter on the result must not label the texts a second time, in a worker of its own
    label = F.pandas_udf(run, shape).asNondeterministic()
    kept = [F.col(c) for c in docs.columns] if carry else [F.col(id_col)]
    return docs.select(*kept, label(F.col(text_col)).alias("_found")).select(*[F.col(c) for c in (docs.columns if carry else [id_col])], "_found.*")
