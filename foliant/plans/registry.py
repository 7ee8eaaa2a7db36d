"""Where named queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.sources.corpus import SQL_MODEL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, model: bool = True):
    """Registers a function under its name; the SQL may use the model's docs, lines and blocks."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {SQL_MODEL.strip()}{sql if sql.lstrip().startswith(',') else ' ' + sql}" if model else sql
        return f

    return add
