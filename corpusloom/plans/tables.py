"""Logical tables over the star schema and the text tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.registry import literal

NODES = """
n_raw AS (
  SELECT 'region:' || r_regionkey AS id, 'service' AS type, r_name AS name, NULL AS file_path FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'module', n_name, NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'file', c_name, 'src/c' || c_custkey || CASE WHEN c_custkey % 10 = 0 THEN '.test.ts' ELSE '.ts' END FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'resource', s_name, NULL FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'function', p_name, 'lib/p' || p_partkey || '.ts' FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'class', o_orderstatus, 'lib/o' || o_orderkey || '.ts' FROM orders),
nodes AS (SELECT * FROM n_raw)"""
EDGES = """
e_raw AS (
  SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'contains' AS type, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 1.0 FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', 1.0 FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'depends_on', 0.5 FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'calls', 0.9 FROM lineitem
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'imports', 0.7 FROM lineitem),
edges AS (SELECT DISTINCT source || '--' || type || '--' || target AS id, source, target, type, weight FROM e_raw)"""
GRAPH = f"WITH {NODES}, {EDGES}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, col: str):
    return F.concat(F.lit(prefix + ":"), F.col(col).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    parts = [
        ("region", "region", "r_regionkey", "service", "r_name", none),
        ("nation", "nation", "n_nationkey", "module", "n_name", none),
        ("customer", "customer", "c_custkey", "file", "c_name", F.concat(F.lit("src/c"), F.col("c_custkey"), F.when(F.col("c_custkey") % 10 == 0, ".test.ts").otherwise(".ts"))),
        ("supplier", "supplier", "s_suppkey", "resource", "s_name", none),
        ("part", "part", "p_partkey", "function", "p_name", F.concat(F.lit("lib/p"), F.col("p_partkey"), F.lit(".ts"))),
        ("orders", "order", "o_orderkey", "class", "o_orderstatus", F.concat(F.lit("lib/o"), F.col("o_orderkey"), F.lit(".ts"))),
    ]
    frames = [table(spark, d, t).select(_key(p, k).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), path.alias("file_path")) for t, p, k, kind, name, path in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        ("nation", "region", "n_regionkey", "nation", "n_nationkey", "contains", 1.0), ("customer", "nation", "c_nationkey", "customer", "c_custkey", "contains", 1.0),
        ("supplier", "nation", "s_nationkey", "supplier", "s_suppkey", "contains", 1.0), ("orders", "customer", "o_custkey", "order", "o_orderkey", "depends_on", 0.5),
        ("lineitem", "order", "l_orderkey", "part", "l_partkey", "calls", 0.9), ("lineitem", "part", "l_partkey", "supplier", "l_suppkey", "imports", 0.7),
    ]
    out = None
    for t, a, ak, b, bk, kind, w in parts:
        f = table(spark, d, t).select(_key(a, ak).alias("source"), _key(b, bk).alias("target"), F.lit(kind).alias("type"), F.lit(w).alias("weight"))
        out = f if out is None else out.unionByName(f)
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Each edge once: equal ends and type have equal weights here, so whole rows are told apart by hashes, and filters on
    an end reach the scan."""
    return named_edges(raw_edges(spark, d).distinct())


def named_edges(raw: DataFrame) -> DataFrame:
    return raw.select(F.concat_ws("--", "source", "type", "target").alias("id"), "source", "target", "type", "weight")


def spread(spark: SparkSession, d: str, rows: list[tuple], schema: str) -> DataFrame:
    """A row for every part: its key p, its group g, and the columns of one of ``rows``; a group has each of them once."""
    n, p = len(rows), F.col("p_partkey")
    forms = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return table(spark, d, "part").select(p.alias("p"), F.floor(p / n).alias("g"), (p % n).cast("int").alias("i")).join(F.broadcast(forms), "i").drop("i")


def spread_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """``spread`` as a common table expression."""
    listed = ", ".join("(" + ", ".join(map(literal, (i, *r))) + ")" for i, r in enumerate(rows))
    return f"{name} AS (SELECT p_partkey AS p, p_partkey // {len(rows)} AS g, t.* EXCLUDE (i) FROM part JOIN (VALUES {listed}) t(i, {columns}) ON p_partkey % {len(rows)} = t.i)"
