"""Registry of named queries: a Spark builder and, where SQL can say it, a
DuckDB oracle string over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def pct_sql(part: str, whole: str) -> str:
    """The SQL twin of ``exprs.pct``: 100 * part / whole in DOUBLE, NULL on 0."""
    return (f"(CASE WHEN CAST({whole} AS DOUBLE) = 0 THEN NULL ELSE "
            f"CAST({part} AS DOUBLE) * CAST(100 AS DOUBLE) / CAST({whole} AS DOUBLE) END)")


def load_all():
    """Import every catalog module so its queries register."""
    from quarry.plans import (catalog_features, catalog_metrics, catalog_models, catalog_profile, catalog_runs,  # noqa: F401
                              catalog_scoring, catalog_validate)
    return QUERIES, ORACLES
