"""Queries over ``pages``."""

from __future__ import annotations

from quarry.llm import arc
from quarry.llm.common import load
from quarry.llm.registry import query


# no DuckDB twin: it has no SHA-1 of bytes in base32; tests compare with hashlib
@query("op1_arc_to_warc")
def op1_arc_to_warc(spark, sf_dir):
    return arc.pages_through_warc(load(spark, sf_dir, "pages"))
