"""Quality rules with n-gram perplexity.

A modified Kneser-Ney model of the characters inside words, one a language, is
counted by Spark over all texts: every task counts its words and then their
n-grams, so map-side sums shrink a text to its distinct n-grams before anything
is shuffled. Continuation counts, count-of-counts, discounts and back-off
weights are aggregations of that table. The model is stored as sorted arrays of
n-gram hashes with their log-probabilities. Hashes have ``BITS`` bits, so the
arrays have at most 2^``BITS`` entries an order whatever the corpus: that bound
is what allows them to travel with the tasks.

A text's perplexity is that of its characters. A language's band follows from
the perplexities of all its texts that pass the base rules.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from bindery.llm.common import mix, once, written

ORDER = 5
BITS = 24
SPREAD = 3.0  # a band reaches so many interquartile ranges beyond the quartiles: the usual bound of what lies far out
LEAST = 0.02  # of the logarithm: a band is no narrower, as in a corpus of equal texts
WORDS = 200_000  # distinct words of a language whose scores a worker remembers
UNKNOWN = "und"
BLANKS = " \t\n\x0b\x0c\r"  # fixed value: what separates words
SYMBOLS = "#*$%&|<>"  # fixed value: the symbols that are counted
PIECE = 64


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8: bytes split at just the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def pieces(words: Counter) -> Iterator[tuple[str, int]]:
    """Distinct words with their counts, as the model sees them: very long ones in pieces of ``PIECE`` characters."""
    for w, n in words.items():
        w = w.decode("utf-8", "surrogatepass")
        for at in range(0, len(w), PIECE):
            yield w[at:at + PIECE], n


def shape(word: str) -> str:
    """The word as the model sees it: lower case, digits as 0, within word ends."""
    word = word.lower()
    return "\x02" + (word if word.isalpha() else regex.sub(r"\p{N}", "0", word)) + "\x03"


def base_counts(text: str | None, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text and its words."""
    text = text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            dup += line in seen
            seen.add(line)
    n, repeated = len(words), 0
    if n >= 3:
        names = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(names.__getitem__, words), np.int64, n)
        pair, size = ids[:-1] * len(names) + ids[1:], len(names)
        if size > 2_000_000:  # three numbers would not fit in 64 bits
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * size + ids[2:]
        order = np.argsort(window)
        equal = window[order][1:] == window[order][:-1]
        if equal.any():
            again = np.zeros(n - 2, bool)
            again[order[1:][equal]] = True
            again[order[:-1][equal]] = True
            covered = np.zeros(n, bool)
            for j in range(3):
                covered[j:n - 2 + j] |= again
            repeated = int(covered.sum())
    return n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup, repeated


def _hashes(lang: str, codes: np.ndarray) -> np.ndarray:
    """Hash of each row of code points."""
    acc = np.full(len(codes), xxhash.xxh3_64_intdigest(lang), np.uint64)
    for column in codes.T:
        acc = mix(acc ^ column.astype(np.uint64))
    return (acc & np.uint64((1 << BITS) - 1)).astype(np.int32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def windows(shaped: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the distinct windows that end inside the words (``ORDER`` wide, 0 before a word's start),
    which of them ends at each place, and the word of each place."""
    lengths = np.array([len(s) for s in shaped])
    letters, ids = np.unique(_codes("".join(shaped)), return_inverse=True)
    ids = ids.astype(np.int64) + 1  # 0: before the word's start
    word = np.repeat(np.arange(len(shaped)), lengths)
    inside = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    base = len(letters) + 1
    key, started = np.zeros(len(ids), np.int64), inside > 0
    for j in range(ORDER - 1, -1, -1):
        if base > 4000:  # five large digits would not fit in 64 bits
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key *= base
        key[j:] += np.where(inside[j:] >= j, ids[:len(ids) - j], 0)
    at = np.flatnonzero(started)
    distinct, which = np.unique(key[at], return_inverse=True)
    last = np.empty(len(distinct), np.int64)
    last[which] = at
    back = last[:, None] - np.arange(ORDER - 1, -1, -1)
    codes = np.where(inside[last][:, None] >= np.arange(ORDER - 1, -1, -1), letters[ids[np.maximum(back, 0)] - 1], 0)
    return codes, which, word[at]


def grams_of(words: list[tuple[str, int]]) -> tuple[list[str], list[int]]:
    """Distinct n-grams that end inside the words, ``ORDER`` characters or from the word's start, and their counts."""
    if not words:
        return [], []
    codes, which, word = windows([shape(w) for w, _ in words])
    n = np.bincount(which, weights=np.array([n for _, n in words], np.float64)[word]).astype(np.int64)
    text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i:i + ORDER].lstrip("\0") for i in range(0, len(text), ORDER)], n.tolist()


def _counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, gram, n): n-grams of ``ORDER`` characters, shorter ones only at word starts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once("n-grams", dict)
        words: dict[str, Counter] = {}
        grams: dict[str, Counter] = {}

        def fold() -> None:
            for lang, seen in words.items():
                into = grams.setdefault(lang, Counter())
                for gram, n in zip(*grams_of(list(pieces(seen)))):
                    into[gram] += n
            words.clear()

        def flush() -> Iterator[pd.DataFrame]:
            for lang, g in grams.items():
                keys, n = list(g), np.fromiter(g.values(), np.int64, len(g))
                for at in range(0, len(keys), 200_000):
                    yield pd.DataFrame({"lang": lang, "gram": keys[at:at + 200_000], "n": n[at:at + 200_000]})
            grams.clear()

        for batch in batches:
            for lang, text in zip(batch["_lang"], batch["_text"]):
                words.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, words.values())) > 200_000:
                fold()
                if sum(map(len, grams.values())) > 1_500_000:
                    yield from flush()
        fold()
        yield from flush()

    rows = docs.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("_lang"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Sorted hash arrays an order: log-probabilities of n-grams, and back-off weights of contexts."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], backs: list[tuple[np.ndarray, np.ndarray]], unseen: dict[str, float]):
        self.grams, self.backs, self.unseen = grams, backs, unseen  # unseen: log-probability of a new character in each language
        self.known: dict[str, dict[str, float]] = {}

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key; values of absent keys are 0."""
        if not len(table[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        found = table[0][at] == keys
        return found, np.where(found, table[1][at], 0)

    def words(self, lang: str, words: list[str]) -> np.ndarray:
        """Log-probability of each word's characters and its end, backing off from the longest known n-gram.

        Words share their windows, so each distinct window is looked up once.
        """
        codes, which, word = windows([shape(w) for w in words])
        total, weight, open_ = np.zeros(len(codes)), np.zeros(len(codes)), np.ones(len(codes), bool)
        for k in range(ORDER, 0, -1):
            here = np.flatnonzero(open_ & (codes[:, ORDER - k] > 0))
            if not len(here):
                continue
            found, p = self._find(self.grams[k - 1], _hashes(lang, codes[here, ORDER - k:]))
            total[here[found]] = weight[here[found]] + p[found]
            open_[here[found]] = False
            if k > 1:
                miss = here[~found]
                weight[miss] += self._find(self.backs[k - 2], _hashes(lang, codes[miss, ORDER - k:ORDER - 1]))[1]
        total[open_] = weight[open_] + self.unseen[lang]
        return np.bincount(word, weights=total[which], minlength=len(words))

    def perplexities(self, lang: str, texts: list[list[bytes]]) -> list[float | None]:
        """Of the characters of each text's words and their ends; None without words or for an unknown language."""
        if lang not in self.unseen:
            return [None] * len(texts)
        known = self.known.setdefault(lang, {})
        counted = [Counter(t) for t in texts]
        new = set().union(*counted).difference(known)
        if len(known) + len(new) > WORDS:
            known.clear()
            new = set().union(*counted)
        long_ = {w for w in new if len(w) > PIECE}
        short = list(new - long_)
        for i in range(0, len(short), 50_000):
            part = [w.decode("utf-8", "surrogatepass") for w in short[i:i + 50_000]]
            known.update(zip(short[i:i + 50_000], zip(self.words(lang, part).tolist(), (len(w) + 1 for w in part))))
        once_: dict[bytes, tuple[float, int]] = {}  # long words are not worth remembering
        for w in long_:
            part = [x for x, _ in pieces(Counter([w]))]
            once_[w] = float(self.words(lang, part).sum()), sum(len(x) + 1 for x in part)
        out: list[float | None] = []
        for words in counted:
            total, chars = 0.0, 0
            for w, n in words.items():
                p, c = known.get(w) or once_[w]
                total += n * p
                chars += n * c
            out.append(math.exp(min(700.0, -total / chars)) if chars else None)
        return out


def _smoothed(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney from the counts: (lang, k, gram, p, context, back), p interpolated up to order k.

    The highest order and n-grams at word starts, which nothing can precede,
    keep their counts; other orders count the distinct characters before them.
    """
    levels, upper = {}, counts
    levels[ORDER] = counts.filter(F.length("gram") == ORDER)
    for k in range(ORDER - 1, 0, -1):
        inner = levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        starts = upper.filter((F.length("gram") == k) & F.col("gram").startswith("\x02"))
        # a prefix of word starts is no continuation of anything longer
        levels[k] = written(inner.unionByName(starts).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "continuations")
    table = levels[1].withColumn("k", F.lit(1))
    for k in range(2, ORDER + 1):
        table = table.unionByName(levels[k].withColumn("k", F.lit(k)))
    table = table.withColumn("context", F.expr("substring(gram, 1, k - 1)"))
    kinds = [F.sum((F.col("n") == i).cast("long")).alias(f"t{i}") for i in (1, 2, 3, 4)]
    t = table.groupBy("lang", "k").agg(*kinds)
    y = F.col("t1") / F.greatest(F.lit(1), F.col("t1") + 2 * F.col("t2"))

    def discount(i: int):
        d = F.lit(float(i)) - F.try_divide((i + 1) * y * F.col(f"t{i + 1}"), F.col(f"t{i}"))
        return F.greatest(F.lit(0.05), F.least(F.coalesce(d, F.lit(0.5)), F.lit(i - 0.05)))

    # one row for each language and order
    t = t.select("lang", "k", discount(1).alias("d1"), discount(2).alias("d2"), discount(3).alias("d3"))
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    table = table.join(F.broadcast(t), ["lang", "k"]).withColumn("cut", cut)
    sums = table.groupBy("lang", "k", "context").agg(F.sum("n").alias("all"), F.sum("cut").alias("freed"))
    table = table.join(sums, ["lang", "k", "context"]).select(
        "lang", "k", "gram", "context", ((F.col("n") - F.col("cut")) / F.col("all")).alias("own"), (F.col("freed") / F.col("all")).alias("back"))
    return written(table, "discounted")


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of all texts. Its arrays have at most 2^``BITS`` entries an order; an empty corpus gives no languages."""
    table = _smoothed(written(_counts(docs, lang_col, text_col), "grams"))
    letters = table.filter("k = 1").groupBy("lang").agg(F.count(F.lit(1)).alias("letters"), F.max("back").alias("rest"))
    unseen = {r.lang: math.log(r.rest / (r.letters + 1)) for r in letters.collect()}  # a row a language
    # p(k) = own + back * p(k - 1) of the gram without its first character
    spread = F.broadcast(letters)
    p = written(table.filter("k = 1").join(spread, "lang").select("lang", "gram", (F.col("own") + F.col("back") / (F.col("letters") + 1)).alias("p")), "order-1")
    by_order = [p]
    for k in range(2, ORDER + 1):
        longer = table.filter(F.col("k") == k).withColumn("short", F.substring("gram", 2, k - 1))
        below = p.select("lang", F.col("gram").alias("short"), F.col("p").alias("q"))
        p = written(longer.join(below, ["lang", "short"], "left").select(
            "lang", "gram", (F.col("own") + F.col("back") * F.coalesce("q", F.lit(1e-6))).alias("p")), f"order-{k}")
        by_order.append(p)

    def arrays(df: DataFrame, text: str, value: str) -> tuple[np.ndarray, np.ndarray]:
        @F.pandas_udf("int")
        def hashed(lang: pd.Series, gram: pd.Series) -> pd.Series:
            out = np.zeros(len(lang), np.int32)
            codes = _codes("".join(gram)).reshape(len(gram), -1)
            for name in lang.unique():
                mine = (lang == name).to_numpy()
                out[mine] = _hashes(name, codes[mine])
            return pd.Series(out)
        # n-grams that share a hash share the mean; at most 2^BITS rows
        found = df.select(hashed("lang", text).alias("h"), F.log(value).alias("v")).groupBy("h").agg(F.avg("v").cast("float").alias("v")).toArrow()
        h, v = found["h"].to_numpy(), found["v"].to_numpy()
        order = np.argsort(h, kind="stable")
        return h[order].astype(np.int32), v[order].astype(np.float32)

    grams = [arrays(p, "gram", "p") for p in by_order]
    contexts = table.filter("k > 1").select("lang", "k", "context", "back").distinct()
    backs = [arrays(contexts.filter(F.col("k") == k), "context", "back") for k in range(2, ORDER + 1)]
    return Model(grams, backs, unseen)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", spread: float = SPREAD) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, low, high.

    ``base_failed``: under 50 words, or more than half of the words in repeated
    three-word windows. ``kept``: not failed, and a perplexity inside the band of
    the language, that is within ``spread`` interquartile ranges (of its
    logarithm) of the quartiles over all texts of the language that pass the
    base rules. A null language is a language of its own; a null or blank text
    has zero words and fails; null ids stay null; repeated rows get equal
    results. An empty table gives no rows. Other columns are not read.
    """
    model = learn(docs, lang_col, text_col)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = once(name, lambda: shared.value)
        for batch in (b.iloc[at:at + 2000].reset_index(drop=True) for b in batches for at in range(0, len(b), 2000)):
            words = [words_of(t) for t in batch["_text"]]
            out = pd.DataFrame([base_counts(t, w) for t, w in zip(batch["_text"], words)], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], dtype="int64")
            out.insert(0, "doc_id", batch["_id"].astype("Int64"))
            out["lang"] = batch["_lang"]
            out["perplexity"] = np.nan
            for lang, at in batch.groupby("_lang").indices.items():
                for i in range(0, len(at), 500):
                    part = at[i:i + 500]
                    out.loc[part, "perplexity"] = [np.nan if x is None else x for x in m.perplexities(lang, [words[j] for j in part])]
            out["perplexity"] = out["perplexity"].astype("Float64")
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("_lang"))
    judged = rows.mapInPandas(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lang string, perplexity double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = written(judged.withColumn("base_failed", failed), "judged")
    quartiles = judged.filter("not base_failed").groupBy("lang").agg(F.percentile_approx(F.log("perplexity"), [0.25, 0.75], 10_000).alias("q"))
    reach = F.greatest(spread * (F.col("q")[1] - F.col("q")[0]), F.lit(LEAST))
    bands = quartiles.select("lang", F.exp(F.col("q")[0] - reach).alias("low"), F.exp(F.col("q")[1] + reach).alias("high"))
    inside = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    # a row a language
    return judged.join(F.broadcast(bands), "lang", "left").select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), "perplexity", "low", "high")
