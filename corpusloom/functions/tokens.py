"""Token estimates and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.model import CHARS_PER_TOKEN, LEVELS
from corpusloom.shared import store

CJK = "[\\u4e00-\\u9fff\\u3400-\\u4dbf]"
DEPTHS = {"none": 3, "reduce_depth": 2, "disable_search": 2, "core_only": 1, "prompt_user": 0}


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, as JavaScript counts."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def ratio(model: Column) -> Column:
    """Characters a token of a model, by the first prefix that fits."""
    out = F.lit(4.0)
    for prefix, r in reversed(CHARS_PER_TOKEN):
        out = F.when(F.lower(model).startswith(prefix), r).otherwise(out)
    return out


def estimate(text: Column, chars_per_token: Column | float = 4.0) -> Column:
    """max(1, ceil(length / max(1, ratio * (1 - cjk share / 2)))); 0 for an empty text or null."""
    n = utf16_length(text)
    share = F.regexp_count(text, F.lit(CJK)) / F.greatest(n, F.lit(1))
    per = F.greatest(F.lit(1.0), (chars_per_token if isinstance(chars_per_token, Column) else F.lit(chars_per_token)) * (1 - 0.5 * share))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(n / per))).cast("long")


def rough(text: Column) -> Column:
    return F.ceil(utf16_length(text) / 4).cast("long")


def level(share: Column) -> Column:
    """Degradation level of a used share of the budget; thresholds are inclusive."""
    out = F.lit("none")
    for least, name in reversed(LEVELS):
        out = F.when(share >= least, name).otherwise(out)
    return out


def depth_of_share(share: float) -> int:
    """Propagation depth that a used share of the budget still allows."""
    return DEPTHS[next((name for least, name in LEVELS if share >= least), "none")]


def adjustments(name: Column) -> dict[str, Column]:
    """What a level allows: depth, files, search, detail, proceed."""
    pick = lambda d, other: F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in d.items()], F.lit(other))
    return {
        "max_depth": pick(DEPTHS, 3), "max_files": pick({"core_only": 3, "prompt_user": 0}, 20), "search": ~name.isin("disable_search", "core_only", "prompt_user"),
        "detail": ~name.isin("core_only", "prompt_user"), "proceed": name != "prompt_user",
    }


def running_sums(rows: DataFrame, group: str, order: str, value: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``used``: the sum of ``value`` within the group up to and with each row, by ``order``.

    Rows are dealt into ranges of (group, order), each range is summed on its own, and a range begins with what the
    ranges before it hold of the group: one number for each range and group. So a group is as many tasks as it has
    ranges, however large it is. Rows of equal group and order lie in one range; which of them comes first is open.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), group, order)
    dealt = store(dealt.withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = dealt.groupBy(group, "__range").agg(F.sum(value).alias("__sum")).select(F.col(group).alias("__group"), F.col("__range").alias("__at"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__begin"))
    within = Window.partitionBy("__range", group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.withColumn("__used", F.sum(value).over(within)).join(begins, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__at")))
    return met.select(*rows.columns, (F.col("__used") + F.col("__begin")).alias("used"))


def running_levels(usage: DataFrame, total: int) -> DataFrame:
    """usage (task, seq, tokens) -> used so far within the task, share of ``total`` and level at each row."""
    rows = running_sums(usage.withColumn("__tokens", F.greatest("tokens", F.lit(0))), "task", "seq", "__tokens").drop("__tokens")
    return rows.withColumn("level", level(F.col("used") / total))


def allowed(used_total: Column, used_category: Column, need: Column, total: int, category: Column) -> Column:
    """Whether both the total and the category's allocation hold ``need`` more tokens."""
    return (used_total + need <= total) & (used_category + need <= category)


def require_budget(status: DataFrame, total: int) -> None:
    """Raise when the tokens used reach the total; one number comes to the driver."""
    used = status.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first().n
    if used >= total:
        raise RuntimeError(f"token budget exhausted: {used} of {total}")
