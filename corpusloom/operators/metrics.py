"""Operational metrics as aggregates over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Percentage rounded to a whole number; 0 of nothing is 0."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole)), F.lit(0.0))


def agent_metrics(runs: DataFrame) -> DataFrame:
    """runs (agent, ms, success) -> calls, total and mean milliseconds, successes, failures, success percentage."""
    g = runs.groupBy("agent").agg(F.count("*").alias("calls"), F.round(F.sum("ms"), 4).alias("total_ms"), F.round(F.avg("ms"), 4).alias("avg_ms"), F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"))
    return g.withColumn("success_pct", percent(F.col("successes"), F.col("calls")))


def rate(hits: Column, all_: Column) -> Column:
    """Share rounded to 4 digits, 0 when empty."""
    return F.round(F.coalesce(F.try_divide(hits, all_), F.lit(0.0)), 4)


def order_statistics(df: DataFrame, col: str, ranks: list[int], buckets: int = 4096, few: int = 10_000) -> dict[int, float]:
    """rank (from 0) -> the value that stands there when the values are sorted: exact, without a sort.

    Each round deals the values that may still be it into ``buckets`` of equal width, whose counts say in which one the
    rank lies; its own least and greatest values are the next bounds. The ends of the bounds have buckets of their own, so
    each round narrows. When ``few`` values or equal ones are left, they come to the driver. Memory is ``buckets`` counts,
    however many rows or distinct values there are. Nulls and NaNs don't count.
    """
    x = df.select(F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double")).alias("x")).where("x is not null")
    out, todo = {}, {}  # (least, greatest) of the values -> [(rank, how many lie before them, their number)]
    first = x.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if any(not 0 <= r < first.n for r in ranks):
        raise ValueError(f"ranks lie between 0 and {first.n - 1}")
    for r in ranks:
        todo.setdefault((first.lo, first.hi), []).append((r, 0, first.n))
    while todo:
        (lo, hi), wanted = todo.popitem()
        inside = x.where(F.col("x").between(lo, hi))
        if lo == hi:
            out |= {r: lo for r, _, _ in wanted}
        elif wanted[0][2] <= few:
            values = sorted(v.x for v in inside.collect())
            out |= {r: values[r - before] for r, before, _ in wanted}
        else:
            at = F.coalesce(F.try_divide(F.col("x") - lo, F.lit(hi) - lo) * buckets, F.lit(0.0))
            at = F.when(F.isnan(at), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(buckets), F.floor(at))))
            bucket = F.when(F.col("x") == lo, -1).when(F.col("x") == hi, buckets + 1).otherwise(at)
            counts = inside.groupBy(bucket.cast("int").alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
            for r, before, _ in wanted:
                for c in sorted(counts, key=lambda c: c.b):
                    if r < before + c.n:
                        todo.setdefault((c.lo, c.hi), []).append((r, before, c.n))
                        break
                    before += c.n
    return out


def exact_quantiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """The exact quantiles of a column, between the two values about each share as ``percentile`` does; None of nothing."""
    n = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).count()
    if not n:
        return [None] * len(shares)
    at = [share * (n - 1) for share in shares]
    found = order_statistics(df, col, sorted({int(r) for a in at for r in (a // 1, -(-a // 1))}))
    return [(low := found[int(a // 1)]) + ((found[int(-(-a // 1))] - low) * (a - a // 1) if a % 1 else 0.0) for a in at]


def distribution(df: DataFrame, col: str) -> DataFrame:
    """min, max, mean and exact median; zeros when there are no rows."""
    (median,) = exact_quantiles(df, col, [0.5])
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return df.agg(F.count(col).alias("n"), zero(F.min(col)).alias("min"), zero(F.max(col)).alias("max"), zero(F.avg(col)).alias("avg"), zero(F.lit(median).cast("double")).alias("median"))


def last_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The last ``n`` rows by ``order`` (descending columns): a top-k, not a sort of everything."""
    return df.orderBy(*order).limit(n)


def last_n_by(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The last ``n`` rows of each key; rows that can't be among them go before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def token_totals(usage: DataFrame) -> DataFrame:
    """usage (category, tokens) -> totals by category and, with category null, of all; negatives count as 0."""
    return usage.rollup("category").agg(F.sum(F.greatest("tokens", F.lit(0))).alias("tokens"))


def savings(diff: DataFrame, tokens_a_file: int = 500) -> DataFrame:
    """diff (level) -> files skipped and reanalysed, and the tokens that skipping saved."""
    skipped = F.count_if(F.col("level").isin("NONE", "COSMETIC"))
    return diff.agg(skipped.alias("skipped"), F.count_if(F.col("level").isin("STRUCTURAL", "added", "deleted")).alias("reanalysed"), (skipped * tokens_a_file).alias("saved_tokens"))
