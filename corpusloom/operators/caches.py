"""Caches as tables: probes, retention, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def probe(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses) of ``wanted``; the cache holds a key once."""
    return wanted.join(cache, key), wanted.join(cache.select(key), key, "left_anti")


def lru(accesses: DataFrame, key: str, time: str, cap: int, tie: str | None = None) -> DataFrame:
    """(key, last): the ``cap`` keys used last. Accesses combine before the shuffle, and the end is a top-k."""
    last = accesses.groupBy(key).agg(F.max(F.struct(time, *([tie] if tie else []))).alias("last"))
    return last.orderBy(F.col("last").desc(), key).limit(cap).select(key, F.col(f"last.{time}").alias("last"))


def upsert_counts(old: DataFrame, new: DataFrame, key: str, count: str) -> DataFrame:
    """Counts summed by key over what was stored and what came."""
    return old.select(key, count).unionByName(new.select(key, count)).groupBy(key).agg(F.sum(count).alias(count))


def upsert_conventions(rows: DataFrame) -> DataFrame:
    """rows (category, rule, seq, confidence) -> the first confidence and a tenth more for each repeat, at most 1."""
    g = rows.groupBy("category", "rule").agg(F.min_by("confidence", "seq").alias("first"), F.count("*").alias("n"))
    return g.select("category", "rule", F.least(F.lit(1.0), F.col("first") + 0.1 * (F.col("n") - 1)).alias("confidence"))
