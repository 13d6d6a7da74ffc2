"""All queries over the reference's operators: name -> (DataFrame builder, equivalent SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheaf.plans import relational, reporting, retrieving, scalars, threading

MODULES: tuple = (scalars, relational, retrieving, reporting, threading)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["rt7_hybrid_query"](spark, sf_dir)
