"""All registered queries of the engine with the DuckDB SQL they are checked against."""

from __future__ import annotations

from .plans import base, engine, lookups, privacy, scalars  # noqa: F401  registering is what importing does

QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL
