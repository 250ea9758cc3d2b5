"""The field catalogue as a table and as literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bindery import fixed

SCHEMA = "document_type string, ordinal int, field_name string, label string, field_type string, required boolean, description string"


def rows() -> list[tuple]:
    """(document_type, ordinal, name, label, type, required, description) for all 14 types."""
    out = []
    for document_type in fixed.DOCUMENT_TYPES:
        if document_type in fixed.NO_FIELD_TYPES:
            continue
        wanted = "COMMON" if document_type in fixed.COMMON_FIELD_TYPES else document_type
        out += [(document_type, *entry[1:]) for entry in fixed.FIELD_CATALOGUE if entry[0] == wanted]
    return out


def table(spark: SparkSession) -> DataFrame:
    """About 130 rows, whatever the data."""
    return spark.createDataFrame(rows(), SCHEMA)


def required_names(document_type: str) -> list[str]:
    return [r[2] for r in rows() if r[0] == document_type and r[5]]


def required_by_type(document_type: Column, skip: list[str] | None = None) -> Column:
    """Required fields of a type as array<struct<name, label, description>>; COMMON for unknown types."""
    def literal(entries: list[tuple]) -> Column:
        structs = [F.struct(F.lit(e[2]).alias("name"), F.lit(e[3]).alias("label"), F.lit(e[6]).alias("description"))
                   for e in entries if e[5] and e[2] not in (skip or [])]
        return F.array(*structs) if structs else F.expr("cast(array() as array<struct<name:string,label:string,description:string>>)")

    all_rows = rows()
    chain = F.when(F.lit(False), literal([]))
    for t in fixed.DOCUMENT_TYPES:
        chain = chain.when(document_type == t, literal([r for r in all_rows if r[0] == t]))
    return chain.otherwise(literal([r for r in all_rows if r[0] == "OTHER"]))
