"""Every query of the package by name, and SQL with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import build_queries, code_queries, finding_queries, fingerprint_queries, graph_queries, metric_queries, source_queries  # noqa: F401
from corpusloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts, orders and customers a faulty supplier affects, with what probability, within three steps."""
    return graph_queries.propagate_upstream(spark, sf_dir)
