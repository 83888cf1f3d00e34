"""Every query of the library by name, with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomrank.plans import analytics, documents, matching, relational, sources_and_sinks, steps
from loomrank.sources import adapters

Query = Callable[[SparkSession, str], DataFrame]


def _relational(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        adapters.register(spark, sf_dir)
        return spark.sql(relational.text(name))

    return run


def queries() -> dict[str, Query]:
    return {name: _relational(name) for name in relational.SQL} | analytics.QUERIES | sources_and_sinks.QUERIES | steps.QUERIES | matching.QUERIES | documents.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: relational.oracle_text(name) for name in relational.SQL} | analytics.ORACLE | {k: f"{adapters.WITH}\n{v}" for k, v in sources_and_sinks.ORACLE.items()} | steps.ORACLE | matching.ORACLE | documents.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["q2_stage_funnel"](spark, sf_dir)
