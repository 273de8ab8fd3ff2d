"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r9(x: Column | str) -> Column:
    """Rounded to nine digits: sums of doubles depend on their order beyond that."""
    return F.round(x if isinstance(x, Column) else F.col(x), 9)


#: The default policy in SQL, for text whose compatibility form is itself.
BASIC_SQL = r"regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[<\[][^>\]]*[>\]]', '', 'g'), '\([^)]+?\)', '', 'g'), '[\p{{M}}\p{{S}}\p{{P}}]', ' ', 'g')), '\s+', ' ', 'g')"


def basic_sql(column: str) -> str:
    return BASIC_SQL.format(column)


WORDS_SQL = "list_filter(string_split_regex({0}, '\\s+'), lambda t: t <> '')"


def words_sql(column: str) -> str:
    return WORDS_SQL.format(column)
