"""Registered queries and their DuckDB oracle SQL."""

from rolevec.catalog.oracle import oracle_sql
from rolevec.catalog.queries import QUERIES

__all__ = ["QUERIES", "oracle_sql"]
