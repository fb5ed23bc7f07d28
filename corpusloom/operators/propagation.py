"""Fault propagation: bounded walks with the greatest product of edge weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.model import rule_rows
from corpusloom.shared import bucketed, offer, store

TEST_FILE = r"\.(test|spec)\."


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), "type string, from_source boolean, from_target boolean")


def allowed(edges: DataFrame, direction: str, min_weight: float = 0.0) -> DataFrame:
    """(src, dst, type, weight): the steps that a direction allows.

    Upstream follows an edge backwards where its rule starts at the target and forwards where it starts at the source;
    downstream follows every edge forwards; both joins the backward steps of the first with the second. The rule table
    has 31 rows whatever the data, so it is broadcast.
    """
    if direction not in ("upstream", "downstream", "both"):
        raise ValueError(direction)
    e = edges.where(F.col("weight") >= min_weight)
    ruled = e.join(F.broadcast(rules(edges.sparkSession)), "type", "left")
    back = ruled.where("from_target").select(F.col("target").alias("src"), F.col("source").alias("dst"), "type", "weight")
    ahead = ruled.where("from_source") if direction == "upstream" else e
    ahead = ahead.select(F.col("source").alias("src"), F.col("target").alias("dst"), "type", "weight")
    return ahead if direction == "downstream" else back.union(ahead)


def reachable(nodes: DataFrame, include_tests: bool = False) -> DataFrame:
    """(id) of the nodes that a trace may enter: all, or those that aren't tests."""
    return (nodes if include_tests else nodes.where(~F.coalesce(F.col("file_path").rlike(TEST_FILE), F.lit(False)))).select("id")


def moves(nodes: DataFrame, edges: DataFrame, direction: str, min_weight: float = 0.0, include_tests: bool = False) -> DataFrame:
    """``allowed`` steps to nodes that exist and aren't tests."""
    return allowed(edges, direction, min_weight).join(reachable(nodes, include_tests).withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type", "weight")


def adjacency(nodes: DataFrame, edges: DataFrame, direction: str = "upstream", min_weight: float = 0.0, include_tests: bool = False) -> DataFrame:
    """``moves`` as a table of buckets by their start, for graphs that are traced more than once: a round of a trace then
    moves its frontier and no edge."""
    return bucketed(moves(nodes, edges, direction, min_weight, include_tests), "moves", "src")


@dataclass
class Trace:
    affected: DataFrame  # node_id, probability, distance, path
    relaxed: DataFrame  # node_id of nodes that improved another
    steps: DataFrame  # src, dst, type, weight, level


def trace(nodes: DataFrame, edges: DataFrame, entry: DataFrame, direction: str = "upstream", max_depth: int = 3, min_weight: float = 0.0, include_tests: bool = False, adjacent: DataFrame | None = None) -> Trace:
    """entry (id) -> every node within ``max_depth`` steps with the greatest product of weights.

    Each round joins the frontier to the moves, keeps one row a node (greatest probability, then the least path) and
    goes on with those that beat what is known: walks are never enumerated, and a round's size is bounded by the
    number of nodes. Moves are ``adjacent``, an ``adjacency`` made before with the same limits, or the allowed steps,
    written once; whether a step's end may be entered is asked of a round's steps only. Ties keep the shorter walk.
    Rounds are written to the shared folder. Repeated edges count once. Entry points that don't exist or are tests are
    ignored; the rest have probability 1 and are left out of the result.
    """
    known = reachable(nodes, include_tests)
    can = store(allowed(edges, direction, min_weight), "moves") if adjacent is None else adjacent
    start = store(known.select("id").join(entry.select("id").distinct(), "id", "left_semi"), "starts")
    front = start.select(F.col("id").alias("node"), F.lit(1.0).alias("p"), F.lit(0).alias("d"), F.array("id").alias("path"))
    fronts, steps = front, None
    for level in range(1, max_depth + 1):
        seen = fronts.groupBy(F.col("node").alias("dst")).agg(F.max("p").alias("before"))
        tried = front.select(F.col("node").alias("src"), "p", "path").join(can, "src")
        tried = tried.join(seen, "dst", "left").where("before is null or p * weight > before")
        if adjacent is None:
            tried = tried.join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
        tried = store(tried.selectExpr("src", "dst", "type", "weight", "p * weight as p", "array_append(path, dst) as path"), f"tried_{level}")
        move = tried.select("src", "dst", "type", "weight", F.lit(level).alias("level"))
        steps = move if steps is None else steps.union(move)
        front = tried.groupBy(F.col("dst").alias("node")).agg(F.min_by(F.struct("p", F.lit(level).alias("d"), "path"), F.struct(-F.col("p"), "path")).alias("b")).select("node", "b.p", "b.d", "b.path")
        front = store(front, f"front_{level}")
        if front.isEmpty():
            break
        fronts = fronts.unionByName(front)
    if steps is None:
        steps = can.select("src", "dst", "type", "weight", F.lit(0).alias("level")).limit(0)
    best = fronts.groupBy("node").agg(F.max_by(F.struct("p", "d", "path"), F.struct(F.col("p"), -F.col("d"))).alias("b")).select("node", "b.p", "b.d", "b.path")
    affected = best.where("d > 0").join(start, best.node == start.id, "left_anti")
    affected = affected.select(F.col("node").alias("node_id"), F.col("p").alias("probability"), F.col("d").alias("distance"), "path")
    return Trace(affected, steps.select(F.col("src").alias("node_id")).distinct(), steps)


def root_causes(t: Trace) -> DataFrame:
    """Affected nodes that never improved another node: where the trail ends; confidence is their probability."""
    return t.affected.join(t.relaxed, "node_id", "left_anti").select("node_id", F.col("probability").alias("confidence"), "distance")


def reach(nodes: DataFrame, edges: DataFrame, entry: DataFrame, direction: str = "both", depth: int = 3, min_weight: float = 0.0, include_tests: bool = False) -> DataFrame:
    """(id): what a ``trace`` with the same limits affects, and the entry points that exist and aren't tests.

    A node is affected if ``depth`` allowed steps lead to it, whatever their weights, so no walk and no probability is
    kept: a round asks of the edges where they are read whether they begin in its front, and writes new nodes only.
    """
    known, steps = reachable(nodes, include_tests), allowed(edges, direction, min_weight)
    seen = front = store(known.join(entry.select("id").distinct(), "id", "left_semi").distinct(), "starts")
    for level in range(1, depth + 1):
        met = steps.join(offer(front).withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        met = store(met.join(offer(seen), "id", "left_anti"), f"met_{level}")
        front = store(known.join(offer(met), "id", "left_semi").distinct(), f"reached_{level}")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def recall_context(nodes: DataFrame, edges: DataFrame, entry: DataFrame, depth: int = 3, min_weight: float = 0.5) -> DataFrame:
    """(id, type): the entry points and all that a trace both ways or upstream reaches. Each step upstream is one of those
    both ways (``allowed``), so one search finds what both traces do. Entry points that are tests are returned, too."""
    found = reach(nodes, edges, entry, "both", depth, min_weight)
    return nodes.join(offer(entry.select("id").union(found).distinct()), "id", "left_semi").select("id", "type")
