"""Every query of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import checks, corpus, evaluation, evidence, packets, planning, retrieval

_FAMILIES = (retrieval, evaluation, corpus, checks, evidence, planning, packets)
QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
SQL = {name: sql for family in _FAMILIES for name, sql in family.SQL.items()}
FLAGSHIP = "w01_bm25_topk"
