"""Named queries and their DuckDB counterparts."""

from __future__ import annotations

from tidemark.plans import documents, learning, market, tables
from tidemark.plans.catalogue import ORACLES, QUERIES

FLAGSHIP = "latest_signals"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "documents", "learning", "market", "tables"]
