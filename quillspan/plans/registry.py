"""Queries of the core operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.plans import claims, courses, data, evaluation, indexing, mapping, planning, records, relational, retrieval, rules, statements, texts, validation
from quillspan.session import ship

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (relational, retrieval, rules, texts, data, courses, records, mapping, statements, claims, indexing, planning, evaluation, validation)


def _shipped(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _shipped(f) for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search: lexical top hits of every benchmark question with the line spans that support them."""
    return queries()["search_evidence"](spark, sf_dir)
