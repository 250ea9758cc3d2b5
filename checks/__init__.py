"""Registered queries, their oracles and the comparison of the two."""

import importlib
import pkgutil


def load_all() -> None:
    """Imports every ``q_*`` module so that its queries register."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"checks.{module}")
