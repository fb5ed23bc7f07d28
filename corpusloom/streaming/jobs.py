"""Stateful counterparts in Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counters(runs: DataFrame) -> DataFrame:
    """Running calls, milliseconds and failures of each agent, for update mode."""
    return runs.groupBy("agent").agg(F.count("*").alias("calls"), F.sum("ms").alias("total_ms"), F.count_if(~F.col("success")).alias("failures"))


def windowed(events: DataFrame, late: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Counts by window and type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_seen(rows: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: a content-keyed cache that forgets."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def budget(usage: DataFrame, total: int) -> DataFrame:
    """usage (task, tokens) -> (task, used, remaining) after each batch; the state of a task is one number and survives
    a restart with the checkpoint."""

    def add(key, frames, state: GroupState):
        used = (state.get[0] if state.exists else 0) + sum(int(f.tokens.clip(lower=0).sum()) for f in frames)
        state.update((used,))
        yield pd.DataFrame({"task": [key[0]], "used": [used], "remaining": [max(0, total - used)]})

    return usage.groupBy("task").applyInPandasWithState(add, "task long, used long, remaining long", "used long", "update", GroupStateTimeout.NoTimeout)


def recent(accesses: DataFrame, cap: int) -> DataFrame:
    """accesses (task, key, seq) -> the keys a task's cache of ``cap`` entries holds after each batch, newest first."""

    def touch(task, frames, state: GroupState):
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        for f in frames:
            for k, s in f.groupby("key").seq.max().items():
                held[k] = max(int(s), held.get(k, -1))
        kept = sorted(held.items(), key=lambda x: (-x[1], x[0]))[:cap]
        state.update(([k for k, _ in kept], [s for _, s in kept]))
        yield pd.DataFrame({"task": [task[0]] * len(kept), "key": [k for k, _ in kept], "seq": [s for _, s in kept]})

    return accesses.groupBy("task").applyInPandasWithState(touch, "task long, key string, seq long", "keys array<string>, seqs array<long>", "update", GroupStateTimeout.NoTimeout)


def upsert(stream: DataFrame, target: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame], every: str | None = None) -> StreamingQuery:
    """Merge each batch into the newest version of a table: version n + 1 is written beside version n and named by the
    batch, so a batch that is run again writes the same version again."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{target}/v{epoch}") if epoch else None
        merge(batch, old).write.mode("overwrite").parquet(f"{target}/v{epoch + 1}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def newest(spark: SparkSession, target: str, epochs: int) -> DataFrame:
    return spark.read.parquet(f"{target}/v{epochs}")
