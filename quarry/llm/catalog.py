"""The registered queries of the training-data operators: opN_<name> and, where
SQL can state them, their DuckDB twins."""

from __future__ import annotations

from quarry.llm import queries_pages, queries_text, queries_vectors  # noqa: F401
from quarry.llm.registry import ORACLES, QUERIES  # noqa: F401
