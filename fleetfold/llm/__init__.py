"""Operators for preparing training text at scale, and the queries that apply them."""

from fleetfold.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
