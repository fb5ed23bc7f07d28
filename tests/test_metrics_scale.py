"""Exact order statistics and running sums that no single task holds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import tokens
from corpusloom.operators import metrics


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(4)


@pytest.mark.parametrize("kind", ["even", "equal", "far apart", "two heaps", "odd", "ends"])
def test_quantiles_are_exact(spark, kind):
    rng = random.Random(kind)
    values = {
        "even": [rng.random() for _ in range(3001)], "equal": [1.5] * 500, "far apart": [2.0 ** rng.randint(-900, 900) for _ in range(1500)],
        "two heaps": [0.0] * 700 + [1e300] * 700 + [-1e300] * 3, "odd": [None, float("nan"), 3.0, -0.0, 7.5], "ends": [math.inf] * 40 + [-math.inf] * 40 + [float(i) for i in range(900)],
    }[kind]
    kept = sorted(v for v in values if v is not None and v == v)
    df = frame(spark, values)
    ranks = sorted({0, 1, len(kept) // 3, len(kept) // 2, len(kept) - 1})
    assert metrics.order_statistics(df, "v", ranks, buckets=64, few=5) == {r: kept[r] for r in ranks}
    if kind not in ("odd", "ends"):
        shares = [0.0, 0.25, 0.5, 0.9, 1.0]
        want = df.agg(*[F.percentile("v", F.lit(s)).alias(str(s)) for s in shares]).first()
        assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(metrics.exact_quantiles(df, "v", shares), want, strict=True))


def test_quantiles_of_nothing(spark):
    assert metrics.exact_quantiles(frame(spark, [None]), "v", [0.5]) == [None]
    assert tuple(metrics.distribution(frame(spark, []), "v").first()) == (0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        metrics.order_statistics(frame(spark, [1.0]), "v", [1])


def test_one_task_is_many_tasks_of_spark(spark):
    rng = random.Random(2)
    rows = [("hot", i, rng.randint(-3, 9)) for i in range(5000)] + [(f"t{i % 7}", i, 1) for i in range(300)] + [(None, i, 2) for i in range(50)]
    rng.shuffle(rows)
    usage = spark.createDataFrame(rows, "task string, seq long, tokens long").withColumn("note", F.lit("x"))
    got = tokens.running_sums(usage.where("tokens >= 0"), "task", "seq", "tokens", 16)
    used, want = {}, {}
    for task, seq, n in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if n >= 0:
            used[task] = used.get(task, 0) + n
            want[task, seq] = used[task]
    assert got.columns == ["task", "seq", "tokens", "note", "used"]
    assert {(r.task, r.seq): r.used for r in got.collect()} == want
    dealt = usage.repartitionByRange(16, "task", "seq").withColumn("p", F.spark_partition_id()).where("task = 'hot'")
    assert dealt.select("p").distinct().count() > 8
    assert tokens.running_levels(usage.limit(0), 10).count() == 0
    levels = tokens.running_levels(usage, 20_000).where("task = 'hot'")
    assert levels.where("level = 'none'").count() and levels.where("level <> 'none'").count() and levels.count() == 5000
