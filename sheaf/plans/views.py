"""SQL access: every query as a temporary view."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sheaf import catalogue


def register(spark: SparkSession, sf_dir: str, *names: str) -> list[str]:
    """Views of the given tables, of the documents with their labels, and of the named queries (all, if none is named)."""
    from sheaf.plans.binding import docs, table

    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    docs(spark, sf_dir).createOrReplaceTempView("docs")
    queries = catalogue.queries()
    for n in names or queries:
        queries[n](spark, sf_dir).createOrReplaceTempView(n)
    return list(names or queries)
