"""Database tables by partitioned predicates, with bounds that come from the database's own counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def bounds(spark: SparkSession, url: str, table: str, key: str, partitions: int, properties: dict[str, str]) -> list:
    """Keys that cut a table into about equal numbers of rows: every ``n / partitions``-th in order, found by the database (one row a cut)."""
    ask = lambda sql: spark.read.jdbc(url, f"({sql}) q", properties=properties)
    n = ask(f'SELECT count({_quoted(key)}) AS "n" FROM {table}').first()[0]
    step = max(1, -(-n // partitions))
    cuts = [ask(f"SELECT {_quoted(key)} FROM {table} WHERE {_quoted(key)} IS NOT NULL ORDER BY {_quoted(key)} OFFSET {at} ROWS FETCH NEXT 1 ROWS ONLY").first()[0] for at in range(step, n, step)]
    return sorted(set(cuts))


def _literal(value) -> str:
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def scan(spark: SparkSession, url: str, table: str, key: str, partitions: int = 8, properties: dict[str, str] | None = None) -> DataFrame:
    """A database table in partitions of about equal rows, however its keys are spread; rows with a null key come with the first.

    Filters and columns go on to the database with each partition's own predicate.
    """
    properties = properties or {}
    cuts = bounds(spark, url, table, key, partitions, properties)
    k = _quoted(key)
    if not cuts:
        return spark.read.jdbc(url, table, properties=properties)
    inner = [f"{k} >= {_literal(a)} AND {k} < {_literal(b)}" for a, b in zip(cuts, cuts[1:], strict=False)]
    predicates = [f"{k} < {_literal(cuts[0])} OR {k} IS NULL", *inner, f"{k} >= {_literal(cuts[-1])}"]
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)
