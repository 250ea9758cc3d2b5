"""Text column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Python's idea of white space, as a set of characters and as a pattern.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SPACE = r"[\s\x1c-\x1f]"
# What ends a line: Python's splitlines, not only the newline.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Both ends stripped of any white space (``trim`` strips only blanks)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    """Null, empty or nothing but white space."""
    return F.coalesce(strip(c) == "", F.lit(True))


def clean_text(c: Column | str) -> Column:
    """Lines right-stripped, at most two blank lines in a row, ends stripped."""
    lines = F.regexp_replace(F.coalesce(col(c), F.lit("")), LINE_BREAK, "\n")
    stripped = F.regexp_replace(lines, r"(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|$)", "")
    return strip(F.regexp_replace(stripped, "\n{4,}", "\n\n\n"))


def lower_extension(filename: Column | str) -> Column:
    """Text after the last dot, lower-cased; empty when there is no dot."""
    f = col(filename)
    return F.when(f.contains("."), F.lower(F.substring_index(f, ".", -1))).otherwise("")


def unicode_pattern(pattern: str, ignore_case: bool = False) -> str:
    """A pattern whose classes, boundaries and letter cases are those of Unicode, as in Python.

    White space is Python's: a no-break space separates words like any other.
    """
    return ("(?iU)" if ignore_case else "(?U)") + pattern.replace(r"\s", SPACE)


def literal_prefixes(pattern: str) -> list[str] | None:
    """Literals of which any match of ``pattern`` must contain one; None if there are none.

    ``(loss\\s+run|claims?\\s+history)`` -> ``loss``, ``claim``.
    """
    body = pattern
    if re.fullmatch(r"\([^()]*(\([^()]*\)[^()]*)*\)", body):
        body = body[1:-1]
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            parts.append(body[start:i])
            start = i + 1
    parts.append(body[start:])
    prefixes = []
    for part in parts:
        literal = re.match(r"[A-Za-z0-9:@_ <-]*", part).group()
        if part[len(literal):len(literal) + 1] in ("?", "*", "{"):
            literal = literal[:-1]
        if not literal:
            return None
        prefixes.append(literal.lower())
    return sorted(set(prefixes))


def matches_sql(lowered: str, pattern: str, text: str | None = None) -> str:
    """SQL condition: column ``text`` (default: the lowered text) matches ``pattern``.

    A byte search for the pattern's literal prefix on the lowered text spares
    the regular expression wherever it cannot match.
    """
    found = f"{lowered} rlike r'{unicode_pattern(pattern)}'" if text is None else f"{text} rlike r'{unicode_pattern(pattern, True)}'"
    prefixes = literal_prefixes(pattern)
    if prefixes is None:
        return f"({found})"
    guard = " or ".join(f"contains({lowered}, '{p}')" for p in prefixes)
    return f"(({guard}) and {found})"


def count_matches_sql(lowered: str, patterns: list[str]) -> str:
    """SQL integer: how many of ``patterns`` occur in the lowered text."""
    return " + ".join(f"cast({matches_sql(lowered, p)} as int)" for p in patterns) or "0"


def first_match_sql(text: str, lowered: str, patterns: list[str]) -> str:
    """SQL integer: number of the first pattern found ignoring case, null when none matches."""
    return "case " + " ".join(f"when {matches_sql(lowered, p, text)} then {i}" for i, p in enumerate(patterns, 1)) + " end"


def limited(c: Column | str, chars: int | None) -> Column:
    """At most ``chars`` characters, for stores with fixed column widths; None keeps all."""
    return col(c) if chars is None else F.substring(col(c), 1, chars)


def preview(c: Column | str, size: int) -> Column:
    c = col(c)
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def title_case(c: Column | str) -> Column:
    """``annual_revenue`` -> ``Annual Revenue``; a letter after any non-letter is raised (``3yr`` -> ``3Yr``)."""
    spaced = F.lower(F.replace(col(c), F.lit("_"), F.lit(" ")))
    pieces = F.split(spaced, r"(?<!\p{L})(?=\p{L})")
    return F.array_join(F.transform(pieces, lambda p: F.concat(
        F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def fixed_point(c: Column, digits: int) -> Column:
    """``%.<digits>f`` of the exact binary value, ties to even, as C and Python print it.

    83.65 is stored as a little more than that and prints as 83.7, though 83.65 * 10
    rounds to the tie 836.5. Taking the powers of two that make up the scale off
    the tie one by one is exact, so what is left tells on which side the value lies.
    """
    scale = 10 ** digits
    size = F.abs(c)
    scaled = size * float(scale)
    below = F.floor(scaled).cast("double")
    rest = tie = below + 0.5
    for bit in reversed(range(scale.bit_length())):
        if scale >> bit & 1:
            rest = rest - size * float(1 << bit)
    exact = F.when(rest < 0, below + 1.0).when(rest > 0, below).otherwise(F.rint(tie))
    whole = F.when(scaled < 2.0 ** 51, exact).otherwise(F.rint(scaled))
    return F.concat(F.when(c < 0, "-").otherwise(""), F.format_string(f"%.{digits}f", whole / float(scale)))
