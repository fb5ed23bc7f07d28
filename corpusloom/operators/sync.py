"""Incremental refresh: what changed between two snapshots, and a rebuild of only that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_level(old_hash: Column, new_hash: Column, old_parts: list[Column], new_parts: list[Column], force: bool = False) -> Column:
    """deleted, added, NONE, STRUCTURAL (a signature differs, null-safe and in order) or COSMETIC."""
    differs = F.lit(False)
    for a, b in zip(old_parts, new_parts, strict=True):
        differs = differs | ~a.eqNullSafe(b)
    out = F.when(new_hash.isNull(), "deleted").when(old_hash.isNull(), "added")
    return out.otherwise("STRUCTURAL") if force else out.when(old_hash == new_hash, "NONE").when(differs, "STRUCTURAL").otherwise("COSMETIC")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, hash_col: str, parts: list[str], force: bool = False) -> DataFrame:
    """(key, level, details): one full outer equi-join of the snapshots; details names the signatures that differ."""
    a, b = old.alias("a"), new.alias("b")
    col = lambda side, c: F.col(f"{side}.{c}")
    level = change_level(col("a", hash_col), col("b", hash_col), [col("a", p) for p in parts], [col("b", p) for p in parts], force)
    why = F.array_join(F.filter(F.array(*[F.when(~col("a", p).eqNullSafe(col("b", p)), F.lit(p)) for p in parts]), lambda x: x.isNotNull()), ",")
    joined = a.join(b, col("a", key) == col("b", key), "full_outer").select(F.coalesce(col("a", key), col("b", key)).alias(key), level.alias("level"), why.alias("details"))
    return joined.withColumn("details", F.when(F.col("level") == "STRUCTURAL", F.col("details")).otherwise(""))


def counters(diff: DataFrame) -> DataFrame:
    """Files by level in one row."""
    names = {"added": "added", "deleted": "deleted", "unchanged": "NONE", "cosmetic": "COSMETIC", "structural": "STRUCTURAL"}
    return diff.agg(*[F.count_if(F.col("level") == v).alias(k) for k, v in names.items()])


def deleted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").select(key)


def affected(diff: DataFrame, depends: DataFrame, key: str) -> DataFrame:
    """(key) of files to rebuild: changed, added and deleted ones, and those that depend on one of them (path, on)."""
    hit = diff.where(F.col("level").isin("STRUCTURAL", "added", "deleted")).select(key)
    users = depends.join(hit.withColumnRenamed(key, "on"), "on", "left_semi").select(F.col("path").alias(key))
    return hit.union(users).distinct()


def sync(built: DataFrame, new: DataFrame, diff: DataFrame, depends: DataFrame, key: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows built from the affected files, with the old rows of all others: equal to building everything anew."""
    hit = affected(diff, depends, key)
    return built.join(hit, key, "left_anti").unionByName(build(new.join(hit, key, "left_semi")))
