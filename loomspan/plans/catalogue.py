"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from loomspan.plans import ingestion, knowledge, lineage, retrieval

_MODULES = (retrieval, knowledge, ingestion, lineage)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
