"""Where queries and their SQL are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callweave.plans.standins import SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql if sql.startswith("with") else SQL + sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
