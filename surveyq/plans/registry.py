"""Where queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyq.session import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(sql: str | None = None):
    """Register build(Tables) under its name, with DuckDB SQL for the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        QUERIES[build.__name__] = run
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return register


def sql_round(value: Column, places: int) -> Column:
    """A double to so many places as DuckDB's round: halves of the product in doubles go up.

    Spark's round goes by the decimal digits: 323 / 640 is 0.5046875 and becomes 0.504688,
    but its product with 10 ** 6 is 504687.49999999994, hence 0.504687 in SQL.
    """
    scaled = F.abs(value) * F.lit(10.0**places)
    whole = F.floor(scaled)
    return F.signum(value) * (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / F.lit(10.0**places)
