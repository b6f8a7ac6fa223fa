"""Registered queries: key -> (Spark builder, DuckDB oracle SQL or None).

Every builder reads the driver's tables from ``sf_dir`` (the query corpus is
derived from ``part`` rows), so the work grows with the data. Outputs are
flat (arrays joined to strings) so the oracle can hash them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules whose import registers queries."""
    from sqlstrata.plans import q_text, q_relational, q_sources  # noqa: F401
