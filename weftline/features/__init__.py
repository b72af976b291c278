"""Feature sets: named functions of cleaned tables, one row for each client.

``FEATURES[name](sources, conf)``; conf holds options such as pinned vocabularies (``conf["vocabulary"]``, a dict of
column to values, saves a pass over a table and fixes the schema) and the number and seed of folds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import categoricals, vocabulary
from ..sources.credit import CLIENT, Sources

FEATURES: dict[str, Callable[[Sources, Mapping], DataFrame]] = {}


def feature(name: str):
    """Register a feature set; its DataFrame has the client key and one row for each client."""

    def register(make: Callable) -> Callable:
        if name in FEATURES:
            raise ValueError(f"{name} is registered")
        FEATURES[name] = make
        return make

    return register


def vocab_of(df: DataFrame, conf: Mapping, columns: list[str] | None = None) -> dict[str, list[str]]:
    """Categories of the string columns: pinned ones from conf, the rest from the data."""
    columns = categoricals(df) if columns is None else columns
    pinned = {c: list(v) for c, v in conf.get("vocabulary", {}).items() if c in columns}
    found = vocabulary(df, [c for c in columns if c not in pinned])
    return {c: pinned.get(c, found.get(c)) for c in columns}


def build(name: str, sources: Sources, conf: Mapping | None = None) -> DataFrame:
    _load()
    return FEATURES[name](sources, conf or {})


def names() -> list[str]:
    _load()
    return sorted(FEATURES)


def _load() -> None:
    from . import application, bureau, credit_card, encoded, grouped, installments, pos_cash, predictions, previous, topics  # noqa: F401


__all__ = ["CLIENT", "F", "FEATURES", "Sources", "build", "feature", "names", "vocab_of"]
