"""Property graphs: a pair of tables, nodes by id and edges by source--type--target."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_write(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row a key: that with the least ``order``, ties to the least row. Combines before the shuffle, unlike a window."""
    rest = [c for c in df.columns if c != key]
    row = F.struct(*rest)
    return df.groupBy(key).agg(F.min_by(row, F.struct(order.alias("_o"), row.alias("_r"))).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def last_write(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row a key: that with the greatest ``order``."""
    rest = [c for c in df.columns if c != key]
    row = F.struct(*rest)
    return df.groupBy(key).agg(F.max_by(row, F.struct(order.alias("_o"), row.alias("_r"))).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def out_edges(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("source") == node)


def in_edges(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("target") == node)


def neighbors(nodes: DataFrame, edges: DataFrame, of: DataFrame, kind: str | None = None) -> DataFrame:
    """of (id) -> (id, neighbor, type, name): both directions, each once, dangling ends dropped."""
    e = edges if kind is None else edges.where(F.col("type") == kind)
    both = e.select(F.col("source").alias("id"), F.col("target").alias("neighbor")).union(e.select("target", "source"))
    met = both.join(of.select("id").distinct(), "id", "left_semi").distinct()
    return met.join(nodes.select(F.col("id").alias("neighbor"), "type", "name"), "neighbor").select("id", "neighbor", "type", "name")


def merge(base: DataFrame, more: DataFrame) -> DataFrame:
    """Union by id; a row of ``base`` wins. ``merge(g, g)`` is ``g``."""
    both = base.withColumn("_p", F.lit(0)).unionByName(more.withColumn("_p", F.lit(1)))
    return first_write(both, "id", F.col("_p")).drop("_p")


def merged(parts: Sequence[DataFrame]) -> DataFrame:
    """``merge`` of tables one after the other, by one aggregation; of one table, the table."""
    if len(parts) == 1:
        return parts[0]
    both = functools.reduce(DataFrame.unionByName, (p.withColumn("_p", F.lit(i)) for i, p in enumerate(parts)))
    return first_write(both, "id", F.col("_p")).drop("_p")


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes ``gone`` (id) and without every edge at one of them."""
    g = gone.select("id").distinct()
    kept = edges.join(g.withColumnRenamed("id", "source"), "source", "left_anti").join(g.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(g, "id", "left_anti"), kept.select(*edges.columns)


def remove_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without everything that belongs to the files ``paths`` (file_path)."""
    p = paths.select("file_path").distinct()
    owned = nodes.join(p, "file_path", "left_semi").select("id")
    return remove_nodes(nodes, edges, owned.union(p.select(F.concat(F.lit("file:"), "file_path"))))


def update_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Columns of ``changes`` (id, ...) that aren't null replace those of the node; unknown ids are ignored."""
    new = changes.select("id", *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != "id"])
    joined = nodes.join(new, "id", "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changes.columns and c != "id" else c for c in nodes.columns])


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in): counted on both ends before one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))
