"""Field-value expressions: unwrapping, numbers, dates, normalised strings.

A field value is JSON text, usually ``{"value": ...}``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bindery.functions.text import SPACE, WHITESPACE, col, strip

PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "_")
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def wrapped_variant(c: Column | str) -> Column:
    """``value`` inside a wrapper object as VARIANT, else the whole value; null if not JSON."""
    v = F.try_parse_json(col(c))
    return F.coalesce(F.try_variant_get(v, "$.value", "variant"), v)


def unwrap(c: Column | str) -> Column:
    """The text of ``value`` inside a wrapper object, else of the value itself.

    JSON null and SQL null both come out as SQL null; lists and objects come
    out as JSON text; text that is no JSON stays as it is.
    """
    v = wrapped_variant(c)
    # one streaming look for the usual wrapper; the full parse only where that finds nothing
    return F.coalesce(F.get_json_object(col(c), "$.value"),
                      F.when(v.isNotNull(), F.try_variant_get(v, "$", "string")).otherwise(col(c)))


def is_zero(c: Column | str) -> Column:
    """True for the JSON number 0, which counts as absent where amounts and dates are read."""
    v = wrapped_variant(c)
    numeric = ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).isin("STRING", "VOID")
    return F.coalesce(numeric & (F.try_variant_get(v, "$", "double") == 0), F.lit(False))


def to_double(c: Column | str) -> Column:
    """Text to double as a plain number; null for anything else (``5d``, ``0x1``)."""
    s = strip(c)
    return F.when(s.rlike(NUMBER), F.regexp_replace(s, "_", "").try_cast("double"))


def parse_currency(c: Column | str) -> Column:
    """``$1,000`` -> 1000, ``5M`` -> 5e6, ``2.5k`` -> 2500; null if it is no amount."""
    s = F.translate(col(c), "$," + WHITESPACE, "")
    suffix = F.upper(F.right(s, F.lit(1)))
    number = F.when(suffix.isin("M", "K"), F.left(s, F.length(s) - 1)).otherwise(s)
    return to_double(number) * F.when(suffix == "M", 1e6).when(suffix == "K", 1e3).otherwise(1.0)


def to_number(c: Column | str) -> Column:
    """An amount or a plain number; as text, every plain number is an amount too."""
    return parse_currency(c)


def parse_date(c: Column | str) -> Column:
    """First of m/d/Y, m-d-Y, Y-m-d, m/d/y, d/m/Y and ``Month d, Y`` that fits.

    Separators and shape are tested first, so that each text meets at most two
    parsers; two-digit years from 69 on are 19xx.
    """
    s = strip(c)
    century = F.when(F.right(s, F.lit(2)) >= "69", "/19").otherwise("/20")
    long_year = F.concat(F.substring_index(s, "/", 2), century, F.right(s, F.lit(2)))
    slashed = (F.when(s.rlike(r"^\d{1,2}/\d{1,2}/(?!0000)\d{4}$"), F.coalesce(F.try_to_date(s, "M/d/yyyy"), F.try_to_date(s, "d/M/yyyy")))
               .when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(long_year, "M/d/yyyy")))
    dashed = (F.when(s.rlike(r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s, "yyyy-M-d"))
              .when(s.rlike(r"^\d{1,2}-\d{1,2}-(?!0000)\d{4}$"), F.try_to_date(s, "M-d-yyyy")))
    named = F.when(s.rlike(r"^[A-Za-z]+\s+\d{1,2},\s+(?!0000)\d{4}$"),
                   F.try_to_date(F.initcap(F.regexp_replace(s, r"\s+", " ")), "MMMM d, yyyy"))
    return F.when(s.contains("/"), slashed).when(s.contains("-"), dashed).when(s.contains(","), named)


def normalise_string(c: Column | str) -> Column:
    """Lower case, punctuation dropped, runs of white space to one blank."""
    s = F.translate(F.lower(F.coalesce(col(c), F.lit(""))), PUNCTUATION, "")
    # most values are plain by now; the Unicode patterns are for the others
    spaced = F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w\s]", ""), rf"(?U){SPACE}+", " ")
    return F.when(s.rlike("^(?:[a-z0-9_]+(?: [a-z0-9_]+)*)?\\z"), s).otherwise(strip(spaced))
