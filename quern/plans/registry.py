"""All queries over the driver's tables by name, and their DuckDB SQL."""

from __future__ import annotations

from . import details, lists, passages, ranking, relational, routing, scoring, search, selection, streams, texts, topics, usage  # noqa: F401  (they register their queries)
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
