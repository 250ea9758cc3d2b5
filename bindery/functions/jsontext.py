"""JSON text helpers for model responses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bindery.functions.text import col, strip

FENCE = "```"


def strip_fences(c: Column | str) -> Column:
    """Leading ```` ```json ```` / ```` ``` ```` and trailing ```` ``` ```` removed."""
    s = strip(c)
    s = F.regexp_replace(s, "^(?:```json)?(?:```)?", "")
    s = F.regexp_replace(s, "```$", "")
    return strip(s)


def json_or_null(c: Column | str) -> Column:
    """The fence-free text as VARIANT; null when it is not JSON."""
    return F.try_parse_json(strip_fences(c))


def is_object(c: Column | str) -> Column:
    """True when the JSON text ``c`` is an object."""
    c = col(c)
    return F.try_parse_json(c).isNotNull() & c.startswith("{")


def object_keys(c: Column | str) -> Column:
    return F.when(is_object(c), F.json_object_keys(col(c)))
