"""Registered queries and their oracles, filled by the ``checks.q_*`` modules."""

from __future__ import annotations

from collections.abc import Callable

from bindery.operators import paging
from bindery.session import ensure_checkpoint_dir, keep_partitions
from bindery.sources.derived import Tables, duck_ctes

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", ctes: list[tuple[str, str]] | None = None, sql: str | None = None):
    """Registers ``fn(tables) -> DataFrame``; ``sql`` is the oracle's final SELECT."""
    def register(fn):
        def run(spark, sf_dir):
            ensure_checkpoint_dir(spark)
            keep_partitions(spark)
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            prefix = duck_ctes(*views.split()) if views else ""
            for cte, body in ctes or []:
                prefix += f"{', ' if prefix else 'with '}{cte} as ({body})"
            ORACLES[name] = f"{prefix} {sql}"
        return fn
    return register


def in_order(df):
    """Adds ``place``, the number of the row in the order in which ``df`` comes, so that the order is compared too."""
    return paging.numbered(df)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lits(texts) -> str:
    return "(" + ", ".join(lit(t) for t in texts) + ")"
