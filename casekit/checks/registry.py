"""All registered queries and their SQL twins."""

from __future__ import annotations

from casekit.checks import charts, ingest, measures, tabular

MODULES = (ingest, tabular, measures, charts)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
