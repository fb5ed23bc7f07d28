"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import held, n_words, settle, small, store

WEIGHTS = (5.0, 2.0, 1.0)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts: the same on every engine and every run."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes (skey, source, source_size) -> the same with target: a share by weight, capped, excess reshared.

    Water level in closed form: with sources sorted by cap over weight, those below the level take their cap and the
    rest share what is left by weight. One row a source; the windows run over that aggregate only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.lit(list(weights)).cast("array<double>"), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("*", pick.alias("weight"), (F.col("source_size") * cap).alias("cap"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*", (F.sum("source_size").over(everything) * budget).alias("total"), F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), "skey")).alias("rn"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"), (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    s = s.select("*", ((F.col("total") - F.col("capped")) / F.col("open")).alias("level"))
    first = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("rn", "level"))).over(everything)
    s = s.select("*", first.alias("first"))
    free = F.coalesce(F.col("rn") >= F.col("first.rn"), F.lit(False))
    return s.select("skey", "source", "source_size", F.when(free, F.least("cap", F.col("first.level") * F.col("weight"))).otherwise(F.col("cap")).alias("target"))


def mix(docs: DataFrame, labels: DataFrame | None = None, weights=WEIGHTS, budget: float = 1.5, cap: float = 2.0, seed: int = 17, buckets: int = 1024, broadcast_sources: int = 10_000) -> DataFrame:
    """doc_id, source, size, source_size, target, key, taken: how many words of each document the mix takes.

    A source with target T and size S takes every document floor(T / S) times, then, in order of the key
    ``-ln(u) / quality weight``, whole documents until the remainder is met; the document that crosses it is taken
    if most of it fits, so a source misses its target by at most half a document. Quality weights come from
    ``labels``: 2 for good, 0.5 for bad, 1 without a label. A null text has size 0 and is taken 0 times; a null source
    is a source of its own, last in order. Repeated rows count as rows of their own; ties of the key go by doc_id.

    No source is sorted in one task: keys fall into ``buckets`` ordered ranges, sums of ranges are prefix-summed, and
    only the one range a source's remainder ends in is sorted by rows.
    """
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    slim = docs.select("doc_id", "source", skey.alias("skey"), n_words(F.col("text")).alias("size"))
    quality = F.lit(1.0)
    if labels is not None:
        marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
        slim = slim.join(marks, "doc_id", "left")
        quality = F.when(F.col("_quality") == 1, 2.0).when(F.col("_quality") == 0, 0.5).otherwise(1.0)
    key = -F.ln(uniform(F.lit(seed), F.col("doc_id"))) / quality
    slim = slim.select("doc_id", "source", "skey", "size", key.alias("key"))
    slim = store(slim.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((1 - F.exp(-F.col("key"))) * buckets)).cast("int")), "mix_slim")

    ranges = slim.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("n"))
    targets = store(source_targets(ranges.groupBy("skey", "source").agg(F.sum("n").alias("source_size")), weights, budget, cap), "mix_targets")
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    plan = targets.select("*", epochs.alias("epochs")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = F.sum("n").over(Window.partitionBy("skey").orderBy("bucket"))
    ends = ranges.select("skey", "bucket", "n", upto.alias("upto")).join(plan.select("skey", "rest"), "skey")
    ends = ends.where("upto > rest").groupBy("skey").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")), "bucket").alias("end"))
    plan = store(plan.join(ends, "skey", "left").select("skey", "source_size", "target", "epochs", "rest", F.coalesce("end.bucket", F.lit(buckets)).alias("last"), F.coalesce("end.before", F.lit(0)).alias("before")), "mix_plan")

    rows = slim.join(F.broadcast(plan) if small(plan, broadcast_sources) else plan, "skey")
    clear = rows.where("bucket <> last").withColumn("more", ((F.col("bucket") < F.col("last")) & (F.col("size") > 0)).cast("long"))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("skey").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    edge = rows.where("bucket = last").withColumn("more", ((2 * ahead + F.col("size") <= 2 * F.col("rest")) & (F.col("size") > 0)).cast("long"))
    both = clear.unionByName(edge)
    return both.select("doc_id", "source", "size", "source_size", "target", "key", ((F.col("epochs") + F.col("more")) * F.col("size")).alias("taken"), (F.col("epochs") + F.col("more")).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as ``mix`` says, none where it takes none; same columns.

    Rows that share doc_id, source and size stand in for each other: as many of them are taken as often as ``mix``
    says. Only where the budget ends among such rows are they ranked, by their texts; all other rows meet their count
    in one equi-join, which shuffles at any size, as the counts are as many as the documents. Null ids and sources meet null ones.
    """
    since = held()
    plan = mix(docs, labels, **options).groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"))
    plan = plan.agg(F.min("copies").alias("__least"), F.max("copies").alias("__most"), F.sum("copies").alias("__all"), F.count("*").alias("__rows")).where("__most > 0")
    plan = settle(plan, "mix_copies", since)
    size = n_words(F.col("text"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__n") == F.col("__size"))
    sized = docs.withColumn("__n", size)
    even = sized.join(plan.where("__least = __most").hint("merge"), on).withColumn("__copies", F.col("__most"))
    split = plan.where("__least <> __most")
    split = sized.join(F.broadcast(split) if small(split, 100_000) else split, on)
    rank = F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64("text")))
    split = split.withColumn("__copies", F.col("__least") + (rank <= F.col("__all") - F.col("__least") * F.col("__rows")).cast("long"))
    rows = even.unionByName(split).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return rows.select(*docs.columns)
