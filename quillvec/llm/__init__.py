"""Operators for preparing large training corpora, with their queries and SQL."""

from .queries import oracle_sql, queries  # noqa: F401
