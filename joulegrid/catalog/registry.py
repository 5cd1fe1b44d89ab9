"""Registration of runnable queries and, where SQL can say the same, their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from joulegrid.catalog.standins import Tables
from joulegrid.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}


def present(rows: DataFrame) -> DataFrame:
    """Comparable output: doubles to six places, decimals as doubles, timestamps without zone."""
    columns = []
    for field in rows.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.DecimalType)):
            column = F.round(column.cast("double"), 6)
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        columns.append(column.alias(field.name))
    return rows.select(*columns)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return present(build(Tables(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        BUILDERS[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def r(expression: str, name: str) -> str:
    """Oracle column: double, six places, no negative zero."""
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0 AS {name}"
