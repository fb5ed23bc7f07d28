"""Rule-based labels: layers, candidate pairs, semantic edges, batches, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from corpusloom.functions import text as T


def layers(nodes: DataFrame) -> DataFrame:
    """nodes (id, name) -> (id, layer, confidence)."""
    return nodes.select("id", T.layer(F.col("name")).alias("l")).select("id", "l.layer", "l.confidence")


def pairs(functions: DataFrame, calls: DataFrame, fallback: int = 8) -> DataFrame:
    """functions (path, name), calls (path, from, to) -> ordered candidate pairs within a file: both directions of its
    calls; every ordered pair in a file that has no calls and at most ``fallback`` functions."""
    f = functions.select("path", "name").distinct()
    both = calls.select("path", F.col("from").alias("a"), F.col("to").alias("b")).union(calls.select("path", "to", "from")).where("a <> b")
    known = both.join(f.withColumnRenamed("name", "a"), ["path", "a"], "left_semi").join(f.withColumnRenamed("name", "b"), ["path", "b"], "left_semi").distinct()
    few = f.groupBy("path").agg(F.count("*").alias("n"), F.collect_set("name").alias("names")).where(F.col("n") <= fallback) if fallback else None
    few = few.join(known.select("path").distinct(), "path", "left_anti").select("path", F.explode("names").alias("a"), "names").select("path", "a", F.explode("names").alias("b")).where("a <> b")
    return known.select("path", "a", "b").union(few)


def edge_label(a: Column, b: Column) -> Column:
    """validates or transforms, by what the first function's name says; null for neither."""
    return F.when(F.lower(a).contains("validate"), "validates").when(F.lower(a).rlike("parse|format|transform|convert"), "transforms")


def semantic_edges(candidates: DataFrame) -> DataFrame:
    c = candidates.withColumn("type", edge_label(F.col("a"), F.col("b"))).where("type is not null")
    return c.select(F.concat_ws(":", F.lit("function"), "path", "a").alias("source"), F.concat_ws(":", F.lit("function"), "path", "b").alias("target"), "type", F.lit(0.6).alias("weight"))


def batches(candidates: DataFrame, most_pairs: int = 25, most_functions: int = 15) -> DataFrame:
    """(path, a, b, batch): pairs of a file in order, packed greedily; a batch closes before a pair that would exceed
    ``most_pairs`` pairs or ``most_functions`` functions. Pairs are read as a sorted stream, so a file of any number of
    pairs takes the memory of one batch."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, k, n, names = None, 0, 0, None  # names is None before the first pair
        for frame in frames:
            ks = []
            for p, a, b in zip(*(frame.column(i).to_pylist() for i in range(3)), strict=True):
                if names is None or p != path:
                    path, k, n, names = p, 0, 0, set()
                if n and (n >= most_pairs or len(names | {a, b}) > most_functions):
                    k, n, names = k + 1, 0, set()
                n += 1
                names |= {a, b}
                ks.append(k)
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(ks, pa.int32())], ["path", "a", "b", "batch"])

    sorted_ = candidates.select("path", "a", "b").repartition("path").sortWithinPartitions("path", "a", "b")
    return sorted_.mapInArrow(work, types.StructType([*sorted_.schema.fields, types.StructField("batch", types.IntegerType())]))


def summary(kind: Column, name: Column, path: Column) -> Column:
    return F.concat(F.initcap(kind), F.lit(" "), name, F.coalesce(F.concat(F.lit(" in "), path), F.lit("")))
