"""Operators for large training-data pipelines. Nothing else in the package imports this one."""

from sylva.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
