"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.shared import held, settle


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a, b of one ordered type) -> (node, root): root is the least node of the component; only linked nodes.

    Large-star and small-star by turns, until no link changes: each round hangs every node's larger, then its smaller
    neighbours on the least one it sees, and depth shrinks by a factor. A root is never looked up, and the tables of
    parents are dealt by themselves, so links that all end in one node are a skewed side that AQE splits. Each round is
    written to the shared folder, so nothing is kept on executors and nothing comes to the driver but two numbers.
    Links with a null end, and of a node with itself, join nothing; repeated links count once.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    since = held()
    pairs, mark = _marked(pairs, "links_0", since)
    for i in range(1, rounds + 1):
        up = pairs.groupBy("hi").agg(F.min("lo").alias("up")).repartition("hi").withColumnRenamed("hi", "at")
        large = pairs.join(up, F.col("lo") == F.col("at"), "left").select("hi", F.coalesce("up", "lo").alias("lo"))
        least = large.groupBy("hi").agg(F.min("lo").alias("m")).repartition("hi")
        small_ = large.join(least, "hi").selectExpr("case when lo = m then hi else lo end as hi", "m as lo").where("hi <> lo").distinct()
        pairs, now = _marked(small_, f"links_{i}", since)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "node")
    return roots.union(roots.select("root", "root").distinct())


def _marked(pairs: DataFrame, name: str, since: int) -> tuple[DataFrame, tuple]:
    """``pairs`` written and read again in place of the round before, with their number and a sum of their hashes."""
    pairs = settle(pairs, name, since)
    return pairs, tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
