"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillage.plans import corpus, crawling, references, search, worklog

_ALL = [pair for module in (corpus, crawling, references, search, worklog) for pair in module.QUERIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query, _ in _ALL}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others are folds and parsers that tests hold against brute force."""
    return {query.__name__: sql for query, sql in _ALL if sql}
