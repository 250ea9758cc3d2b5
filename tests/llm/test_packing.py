import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bindery.llm import packing
from tests.llm import helpers

PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def check(rows, documents, max_tokens, max_segments, max_loss):
    """Every id once, gapless sequences, limits kept; returns the padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, ids in documents.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max_tokens and len(s) <= max_segments and sum(r.loss_tokens for r in s) <= max_loss
        padding += s[0].padded_to - at
        assert s[0].padded_to >= at
    return padding


def test_whole_texts_like_the_tokenizer(spark):
    rng = random.Random(2)
    texts = {i: helpers.prose(rng, rng.choice([1, 3, 40, 900, 6000])) for i in range(60)}
    texts |= {100: "", 101: None, 102: "a\tb c  d\r\n e", 103: "I'm <|endoftext|> é É 語　語 🙂 x'll", 104: " lead and trail "}
    docs = helpers.documents(spark, [(i, t, "en", "a") for i, t in texts.items()]).repartition(3)
    rows = packing.pack(docs, PATH).collect()
    padding = check(rows, {i: [*ids_of(t), 2] for i, t in texts.items()}, 4096, 128, 4096)
    assert padding == 0


def test_limits_on_segments_and_loss(spark):
    rng = random.Random(4)
    rows = [(i, helpers.prose(rng, rng.randint(0, 12)), helpers.prose(rng, rng.choice([0, 3, 60])), 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt string, n int").repartition(2)
    got = packing.pack(docs, PATH, prompt_col="prompt", max_tokens=64, max_segments=4, max_loss=20).collect()
    want = {i: [*ids_of(p), *ids_of(t), 2] for i, t, p, _ in rows}
    check(got, want, 64, 4, 20)
    assert sum(r.loss_tokens for r in got) == sum(len(ids_of(t)) + 1 for _, t, _, _ in rows)
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, max_segments=0)


def test_edges(spark):
    rows = packing.pack(helpers.edge_documents(spark), PATH).collect()
    assert [r.length for r in rows if r.doc_id == 2] == [1] and sum(r.length for r in rows if r.doc_id == 4) == 6
    assert any(r.doc_id is None for r in rows)
    assert packing.pack(helpers.documents(spark, []), PATH).count() == 0


def test_plain_words_by_ranks_like_the_tokenizer():
    """Plain words go by byte ranks; their ids are the tokenizer's own, word by word."""
    rng, known = random.Random(6), packing._Words(PATH)
    assert known.ranked is not None
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZ0123456789''!-~.,;<>/|_=#ÀÉÖØßäöüÿñ"
    entries = [e.replace("</w>", "") for e in TOKENIZER.get_vocab() if all("!" <= c <= "~" for c in e)]
    words = ["".join(rng.choices(letters, k=rng.randint(0, 20))) for _ in range(3000)] + ["".join(rng.choices(entries, k=3)) for _ in range(3000)]
    words += ["a" * 300, "=" * 300, "", "'s", "IT'S'll", "</w>"]
    odd = ["<|endoftext|>x", "é", "a\0b", "\0", "İ", "x\ty", "語", "ſ"]
    for part in (words, [*words[:50], *odd], odd):
        part = list(dict.fromkeys(part))
        assert [np.frombuffer(ids, "<u4").tolist() for ids in known.encoded(part)] == [ids_of(w) for w in part]


def test_passing_words_are_not_kept(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 1000)
    texts = [f"word{i} common " + "x" * 80 for i in range(500)]
    for _ in range(2):
        assert [ids.tolist() for ids in packing.token_ids(texts, PATH)] == [ids_of(t) for t in texts]
    known = packing.once(("packing", PATH), lambda: None)
    assert len(known.ids) < 10
    packing.once("another operator", dict)
