import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from bindery.llm import alignment
from tests.llm import helpers

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CHARS = alignment.byte_level()
ODD = ["", " ", "  lead", "trail  ", "a  b   c", "tab\t b\n  c\r\n d", "U+2581 ▁ is no space", "a▁b", "ﬁ Å é 語　語 🙂   nb sp \x1c x\x1c y", "<s> </s> <|endoftext|> <unk>",
       "I'm we'll x's\n\n\nnew", "\x00 nul \x85   line", "no-space" * 400, "\n \n \t \n", "é combining", "…—“quoted” 123,456.78", "   x", "x  y 　 z"]


def tokens(text):
    """(A ids, A bytes, B ids, B bytes) of a whole text, encoded in one go; empty where the bytes differ."""
    if not text:
        return [], [], [], []
    a = Tokenizer.from_file(A) if not hasattr(tokens, "a") else tokens.a
    tokens.a = a
    a.encode_special_tokens = True
    b = tokens.b = getattr(tokens, "b", None) or sentencepiece.SentencePieceProcessor(model_file=B)
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    xs = [bytes(CHARS[c] for c in a.id_to_token(i)) for i in x]
    ys = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    want = (" " + text).encode()
    return (x, xs, y, ys) if b"".join(xs) == want == b"".join(ys) else ([], [], [], [])


def brute(texts):
    """Rows of the contract by offsets alone."""
    cut, links = [], []
    for text in texts:
        x, xs, y, ys = tokens(text)
        ends = []
        for parts in (xs, ys):
            at, found = 0, []
            for p in parts:
                at += len(p)
                found.append(at)
            ends.append(found)
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for end in both:
            k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
            i, j = k, m
        last = dict(zip(ends[1], y))
        links.append([(s, last[e]) for s, e in zip(x, ends[0]) if e in last])
        cut.append((len(x), len(y), groups))
    count = Counter(p for own in links for p in own)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(n_a, n_b, len(g), len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for (n_a, n_b, g), own in zip(cut, links)]


def sample():
    rng = random.Random(5)
    marks = [" ", " ", " ", "  ", "\n", "\n ", ". ", ", ", "\t", "-", "'s ", " ", " \n"]
    made = ["".join(helpers.prose(rng, 1) + rng.choice(marks) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return ODD + made + [None, made[0], made[0]]


@pytest.mark.parametrize("most_pairs", [alignment.PAIRS, 10])
def test_like_whole_texts_encoded_at_once(spark, most_pairs):
    texts = sample()
    docs = helpers.documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).repartition(3)
    rows = {r.doc_id: tuple(r)[1:] for r in alignment.align(docs, A, B, most_pairs=most_pairs).collect()}
    want = brute(texts)
    for i, text in enumerate(texts):
        assert rows[i] == want[i], repr(text)[:80]


def test_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = docs.orderBy("doc_id").collect()
    rows = {r.doc_id: tuple(r)[1:] for r in alignment.align(docs.repartition(4), A, B).collect()}
    assert [rows[r.doc_id] for r in texts] == brute([r.text for r in texts])


def test_long_text_in_slices_and_small_memory(spark, monkeypatch):
    rng = random.Random(6)
    text = helpers.prose(rng, 20_000, [helpers.prose(rng, 1) + str(i) for i in range(3000)])
    aligner = alignment.Aligner(A, B)
    monkeypatch.setattr(alignment, "UNITS", 700)
    monkeypatch.setattr(alignment, "MEMORY", 200_000)
    n = 0
    shas = hashlib.sha256()
    for k, (owner, place) in enumerate(alignment._slices(aligner, [text])):
        n += int(aligner.table[place, 0].sum())
        shas.update(((";" if k else "") + ";".join(aligner.texts[p] for p in place)).encode())
    want = brute([text])[0]
    assert (n, shas.hexdigest()) == (want[0], want[-1])


def test_edges(spark):
    docs = helpers.edge_documents(spark)
    rows = alignment.align(docs, A, B, groups=True).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].groups_sha256 == "" == by[2].groups and by[1].n_links == 0
    assert by[None].n_a > 0 and [r.count_sum for r in rows if r.doc_id == 4][0] == [r.count_sum for r in rows if r.doc_id == 4][1]
    assert hashlib.sha256(by[5].groups.encode()).hexdigest() == by[5].groups_sha256 == by[6].groups_sha256
    assert alignment.align(helpers.documents(spark, []), A, B).count() == 0
    assert alignment.align(helpers.documents(spark, [(1, None, None, None)]), A, B, most_pairs=0).first().n_links == 0


def test_string_ids_and_pairs_of_another_corpus(spark):
    docs = spark.createDataFrame([("x", "some words here"), (None, "unseen zebra")], "doc_id string, text string")
    pairs = alignment.pair_counts(alignment.aligned(docs.filter("doc_id = 'x'"), A, B), A, B)
    rows = {r.doc_id: r for r in alignment.align(docs, A, B, pairs=pairs).collect()}
    assert rows["x"].n_best == rows["x"].n_links == rows["x"].count_sum and rows[None].count_sum == 0
