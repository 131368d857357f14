"""Registry of named queries: Spark builder + DuckDB oracle SQL.

Every query takes ``(spark, sf_dir)`` and reads the driver's tables (or views
Spark derives from them), so its work grows with the data. Queries whose
semantics are sequential and not reasonably expressible in SQL are registered
without an oracle and are checked in tests against a brute-force model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is the DuckDB oracle (optional)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from linklens.plans import q_cache, q_core, q_ids, q_intake, q_links, q_metrics, q_seq  # noqa: F401
    from linklens.plans import q_stream  # noqa: F401  (after the batch twins: reuses their oracles)
