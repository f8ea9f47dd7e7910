"""Operators of a training-data pipeline. Nothing else in the package imports this one."""

from lexigrove.llm import queries, vector_queries

QUERIES = {**queries.QUERIES, **vector_queries.QUERIES}
ORACLE_SQL = {**queries.ORACLE_SQL, **vector_queries.ORACLE_SQL}

__all__ = ["ORACLE_SQL", "QUERIES"]
