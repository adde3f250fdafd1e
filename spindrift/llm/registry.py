"""The queries of the training-data operators."""

from __future__ import annotations

from spindrift.llm import decontaminate, fingerprint, html, jaccard, lines, lm, packing, quality, tokencount, warc

MODULES = [html, warc, jaccard, lm, lines, decontaminate, tokencount, quality, packing, fingerprint]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
