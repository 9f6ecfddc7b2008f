"""All queries with their SQL."""

from __future__ import annotations

from . import blocks, code, examples, io, labels, prep, retrieval, scores

MODULES = (retrieval, prep, labels, examples, scores, io, blocks, code)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
