"""Queries of the linkage engine by name, and the DuckDB SQL they are held against."""

from __future__ import annotations

from orderweave.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

FLAGSHIP = "link_flagship"
