"""Registered queries: a Spark function over the tables of a folder and, next to it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditmill.session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# White space as Python knows it, for the SQL side.
SQL_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def sql_strip(expression: str) -> str:
    return rf"regexp_replace({expression}, '\A{SQL_BLANK}+|{SQL_BLANK}+\z', '', 'g')"


def sql_lines(expression: str) -> str:
    """Lines of a text without the empty piece after a final line end."""
    return rf"string_split_regex(regexp_replace({expression}, '({SQL_LINE_END})\z', ''), '{SQL_LINE_END}')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that is heavy per row."""
    return spread(table(spark, folder, name).select(*columns))
