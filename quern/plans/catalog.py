"""All queries of the core: name to query, and name to the SQL that must give the same rows."""

from __future__ import annotations

from quern.plans import collection, general, ingest, parsing, records, requests, retrieval, scalars

FLAGSHIP = "rrf_fusion_pool"
_PARTS = (general, scalars, retrieval, ingest, requests, collection, records, parsing)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
