"""Licence scan: identifier tags and notice phrases, found by one Aho-Corasick pass, and licence expressions.

A text is reduced to its words with one blank between them; an automaton over
" phrase " keys finds every place of every phrase in one pass over the whole
text. Tags ("SPDX-License-Identifier:", "license =") are keys too; only where one
is found the text behind it is read again as a licence expression. A
shunting-yard parser turns that into postfix order, which is evaluated with
obligations as values: of "or" the licensee takes the lighter one, "and" keeps
the heavier one, "with" an exception lightens its licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bindery.llm.common import by_size, once

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Obligations from the lightest to the heaviest.
OBLIGATIONS = ("none", "notice", "share-file", "share-work", "share-network", "no-grant")

#: Licence identifiers of expressions with their obligation.
IDENTIFIERS = {
    "0bsd": "none", "cc0-1.0": "none", "unlicense": "none", "wtfpl": "none",
    "apache-1.1": "notice", "apache-2.0": "notice", "artistic-2.0": "notice", "bsd-2-clause": "notice", "bsd-3-clause": "notice",
    "bsd-4-clause": "notice", "bsl-1.0": "notice", "cc-by-3.0": "notice", "cc-by-4.0": "notice", "isc": "notice", "mit": "notice", "mit-0": "notice",
    "ncsa": "notice", "ofl-1.1": "notice", "openssl": "notice", "postgresql": "notice", "python-2.0": "notice", "x11": "notice", "zlib": "notice",
    "cddl-1.0": "share-file", "cddl-1.1": "share-file", "epl-1.0": "share-file", "epl-2.0": "share-file", "mpl-1.1": "share-file", "mpl-2.0": "share-file",
    "lgpl-2.0": "share-file", "lgpl-2.1": "share-file", "lgpl-3.0": "share-file",
    "cc-by-sa-3.0": "share-work", "cc-by-sa-4.0": "share-work", "eupl-1.2": "share-work", "gpl-1.0": "share-work", "gpl-2.0": "share-work", "gpl-3.0": "share-work",
    "agpl-1.0": "share-network", "agpl-3.0": "share-network", "sspl-1.0": "share-network",
    "cc-by-nc-4.0": "no-grant", "cc-by-nc-nd-4.0": "no-grant", "cc-by-nd-4.0": "no-grant", "busl-1.1": "no-grant",
}

#: Notice phrases beyond the base, their label, and how sure a place of one is.
NOTICES = [
    ("mit license", "mit", 0.8), ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.9),
    ("apache license", "apache", 0.8), ("apache license version 2 0", "apache-2.0", 0.9), ("apache 2 0 license", "apache-2.0", 0.8),
    ("www apache org licenses license 2 0", "apache-2.0", 0.9),
    ("bsd license", "bsd", 0.8), ("2 clause bsd license", "bsd-2-clause", 0.9), ("3 clause bsd license", "bsd-3-clause", 0.9),
    ("redistribution and use in source and binary forms", "bsd", 0.8),
    ("gnu general public license", "gpl", 0.9), ("general public license version 2", "gpl-2.0", 0.9), ("general public license version 3", "gpl-3.0", 0.9),
    ("gnu gpl", "gpl", 0.8), ("gplv2", "gpl-2.0", 0.7), ("gplv3", "gpl-3.0", 0.7),
    ("lesser general public license", "lgpl", 0.9), ("library general public license", "lgpl", 0.9), ("gnu lgpl", "lgpl", 0.8),
    ("affero general public license", "agpl", 0.9), ("gnu agpl", "agpl", 0.8),
    ("mozilla public license", "mpl", 0.8), ("mozilla public license version 2 0", "mpl-2.0", 0.9), ("mozilla public license 2 0", "mpl-2.0", 0.9),
    ("eclipse public license", "epl", 0.8), ("common development and distribution license", "cddl", 0.8),
    ("isc license", "isc", 0.8), ("zlib license", "zlib", 0.8), ("boost software license", "bsl-1.0", 0.8), ("artistic license", "artistic", 0.8),
    ("open font license", "ofl-1.1", 0.8), ("unlicense org", "unlicense", 0.8), ("server side public license", "sspl-1.0", 0.8),
    ("creative commons attribution", "cc-by", 0.8), ("creative commons attribution sharealike", "cc-by-sa", 0.9),
    ("creative commons attribution noncommercial", "cc-by-nc", 0.9), ("creative commons attribution noderivs", "cc-by-nd", 0.9),
    ("cc by sa", "cc-by-sa", 0.8), ("cc by nc", "cc-by-nc", 0.8), ("cc by nd", "cc-by-nd", 0.8), ("cc0", "cc0-1.0", 0.6),
    ("released into the public domain", "public-domain", 0.8), ("dedicated to the public domain", "public-domain", 0.8),
    ("proprietary and confidential", "proprietary", 0.8), ("confidential and proprietary", "proprietary", 0.8),
    ("unauthorized copying of this file", "proprietary", 0.8),
]

#: Tags before a licence expression, and how sure a parsed expression behind one is.
TAGS = [("spdx license identifier", 0.95), ("license", 0.7), ("licence", 0.7), ("license expression", 0.8)]
_BASE_SURE = {"cc-by": 0.6, "gpl": 0.8, "reserved": 0.5}
_UNSURE = 0.3  # a tag whose expression does not parse

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.:+-]*))")
_BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(text: str, strict: bool) -> list[str] | None:
    """The longest licence expression at the start of ``text`` in postfix order (shunting-yard); None if there is none.

    A name that is no known identifier may only stand first, after "with", or as
    a "LicenseRef-" name; ``strict`` also asks for a known one in the first place.
    Parentheses must match.
    """
    out: list[str] = []
    stack: list[str] = []
    best: list[str] | None = None
    at, operand, depth = 0, True, 0
    while m := _TOKEN.match(text, at):
        mark, name = m.group(1), (m.group(2) or "").rstrip(".:-").lower()
        if mark == "(" and operand:
            stack.append("(")
            depth += 1
        elif mark == ")" and not operand and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif name in _BINDS and not operand:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[name]:
                out.append(stack.pop())
            stack.append(name)
            operand = True
        elif name and operand and name not in _BINDS:
            after_with = bool(stack) and stack[-1] == "with"
            if not (after_with or known(name) or name.startswith(("licenseref-", "documentref-")) or not out and not strict):
                break
            out.append(name)
            operand = False
        else:
            break
        at = m.end() if mark else m.start(2) + len(m.group(2).rstrip(".:-"))
        if not operand and not depth:
            best = out + [x for x in reversed(stack)]
    return best


def known(name: str) -> str | None:
    """The identifier without "+", "-only" or "-or-later", if it is one."""
    for end in ("+", "-or-later", "-only"):
        name = name.removesuffix(end)
    return name if name in IDENTIFIERS else None


def evaluate(order: list[str]) -> tuple[str | None, set[str]]:
    """Obligation of a postfix expression (None if it rests on unknown names) and its identifiers."""
    values: list[int | None] = []
    labels: set[str] = set()
    for i, token in enumerate(order):
        if token in _BINDS:
            b, a = values.pop(), values.pop()
            if token == "with":  # an exception: a licence on works asks no more than one on files
                values.append(a if a is None else min(a, OBLIGATIONS.index("share-file")) if a <= OBLIGATIONS.index("share-network") else a)
            elif token == "or":
                values.append(min((x for x in (a, b) if x is not None), default=None))
            else:
                values.append(None if a is None or b is None else max(a, b))
        elif i + 1 < len(order) and order[i + 1] == "with":
            values.append(None)  # the exception's name
        else:
            name = known(token)
            labels.add(name or ("licenseref" if token.startswith(("licenseref-", "documentref-")) else "unknown"))
            values.append(OBLIGATIONS.index(IDENTIFIERS[name]) if name else None)
    return (None if values[-1] is None else OBLIGATIONS[values[-1]]), labels


def automaton():
    """Keys are " phrase "; values (kind, label, words, how sure)."""
    import ahocorasick
    made = ahocorasick.Automaton()
    keys: dict[str, list] = {}
    for phrase, label in BASE.items():
        keys.setdefault(phrase, []).append(("base", label, _BASE_SURE[label]))
    for phrase, label, sure in NOTICES:
        keys.setdefault(phrase, []).append(("notice", label, sure))
    for phrase, sure in TAGS:
        keys.setdefault(phrase, []).append(("tag", phrase, sure))
    for phrase, entries in keys.items():
        made.add_word(f" {phrase} ", (phrase.count(" ") + 1, entries))
    made.make_automaton()
    return made


def _expression(raw: bytes, ends: list[int], word: int, tag: str, width: int) -> tuple[str | None, list[str]] | None:
    """The line behind a tag as (expression, postfix order); None where no tag is meant."""
    rest = raw[ends[word + width - 1]:].split(b"\n", 1)[0]
    mark = re.match(rb"""["']?[ \t]*[:=][ \t]*["']?""", rest)
    if mark is None:
        return None
    line = rest[mark.end():].decode("utf-8", "replace")
    order = postfix(line, strict=tag != "spdx license identifier")
    if order is None:
        return (None, []) if tag == "spdx license identifier" and line.strip() else None
    return " ".join(order), order


def findings(text: str | None, made) -> tuple[int, list[tuple]]:
    """Number of words, and (kind, label, first word, words, how sure, expression, obligation) of every place, in order."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_WORDS).split()
    plain = (b" " + b" ".join(words) + b" ").decode("latin-1")
    out: list[tuple] = []
    ends: list[int] | None = None
    at = seen = 0
    for end, (width, entries) in made.iter(plain):
        # blanks before the key's last one: as many as words before it
        seen += plain.count(" ", at, end)
        at = end
        word = seen - width
        for kind, label, sure in entries:
            if kind != "tag":
                out.append((kind, label, word, width, sure, None, None))
                continue
            ends = [m.end() for m in _WORD.finditer(raw)] if ends is None else ends
            found = _expression(raw, ends, word, label, width)
            if found is None:
                continue
            shown, order = found
            if not order:
                out.append(("tag", "invalid", word, width, _UNSURE, None, None))
                continue
            duty, labels = evaluate(order)
            out += [("tag", name, word, width, sure if name != "unknown" else _UNSURE, shown, duty) for name in sorted(labels)]
    out.sort(key=lambda f: (f[2], f[0], f[1]))
    return len(words), out


_PLACE = pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("sure", pa.float64()),
                    ("expression", pa.string()), ("obligation", pa.string())])
_SHAPE = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "obligation string, findings array<struct<kind: string, label: string, word: long, words: long, sure: double, expression: string, obligation: string>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, obligation, findings.

    Words are runs of ASCII letters, digits and code points from U+0080 on, only
    A-Z lower-cased. ``n_base`` counts the places of base phrases, with the first
    and last start (null without one). ``labels`` adds those of notices and of
    licence expressions to the base ones; both lists are distinct, sorted and
    joined by commas. ``score`` is 1 - the product of (1 - how sure) over the
    distinct labels. ``obligation`` is the heaviest that an expression evaluates
    to, null without one. ``findings`` has every place.

    Null texts are empty: no words, '' and 0. Texts are read whole. Null ids stay
    null; repeated rows get equal results. An empty table gives no rows. Other
    columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = once("licences", automaton)
        for batch in by_size(batches, "_text"):
            columns: dict[str, list] = {c.split()[0]: [] for c in _SHAPE.split(", ")[:8]} | {"findings": []}
            for text in batch.column("_text").to_pylist():
                n, found = findings(text, made)
                base = [f for f in found if f[0] == "base"]
                sure: dict[str, float] = {}
                for f in found:
                    sure[f[1]] = max(sure.get(f[1], 0.0), f[4])
                rest = 1.0
                for label in sorted(sure):
                    rest *= 1 - sure[label]
                duties = [OBLIGATIONS.index(f[6]) for f in found if f[6]]
                for column, value in zip(columns.values(), (
                        n, len(base), base[0][2] if base else None, base[-1][2] if base else None, ",".join(sorted({f[1] for f in base})),
                        ",".join(sorted(sure)), 1 - rest, OBLIGATIONS[max(duties)] if duties else None,
                        [dict(zip(("kind", "label", "word", "words", "sure", "expression", "obligation"), f)) for f in found])):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string(), pa.list_(_PLACE)]
            arrays = [batch.column("_id")] + [pa.array(v, k) for v, k in zip(columns.values(), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", *columns])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"id {kind}, {_SHAPE}").withColumnRenamed("id", id_col)
