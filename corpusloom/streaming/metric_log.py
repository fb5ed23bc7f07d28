"""Metrics as a log of batches within epochs, and snapshots that stand for the log so far."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import metrics

RUNS = "agent string, ms double, success boolean"
TOTALS = "agent string, calls long, total_ms double, successes long, failures long"


@dataclass(frozen=True)
class MetricLog:
    """Tables under ``root``: ``log`` has the totals of each batch of an epoch, ``snapshot`` the totals of an epoch up to a
    batch, ``epoch`` the epochs that were opened. Nothing is changed once it is written; a batch that is run again
    writes its own folder again."""

    spark: SparkSession
    root: str

    def _folders(self, of: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{of}")
        disk = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in disk.listStatus(path)] if disk.exists(path) else []
        done = lambda p: disk.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(p.getName() for p in found if done(p))

    def epoch(self) -> int:
        """The epoch that is open: the last that a reset opened."""
        return max((int(n) for n in self._folders("epoch")), default=0)

    def reset(self) -> int:
        """Open a new epoch, empty; what was logged before stays where it is."""
        now = self.epoch() + 1
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/epoch/{now:08d}")
        return now

    def append(self, runs: DataFrame, batch: int) -> None:
        """Log the runs (agent, ms, success) of a batch as totals by agent."""
        g = runs.groupBy("agent").agg(F.count("*").alias("calls"), F.sum("ms").alias("total_ms"), F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"))
        g.write.mode("overwrite").parquet(f"{self.root}/log/{self.epoch():08d}-{batch:012d}")

    def _snapshot(self, epoch: int) -> tuple[str | None, int]:
        names = [n for n in self._folders("snapshot") if n.startswith(f"{epoch:08d}-")]
        return (names[-1], int(names[-1].split("-")[1])) if names else (None, -1)

    def load(self) -> DataFrame:
        """Totals by agent of the open epoch: the latest snapshot with the batches after it."""
        epoch = self.epoch()
        name, upto = self._snapshot(epoch)
        tail = [f"{self.root}/log/{n}" for n in self._folders("log") if n.startswith(f"{epoch:08d}-") and int(n.split("-")[1]) > upto]
        paths = tail + ([f"{self.root}/snapshot/{name}"] if name else [])
        rows = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        g = rows.groupBy("agent").agg(*[F.sum(c).alias(c) for c in ("calls", "total_ms", "successes", "failures")])
        return g.withColumn("success_pct", metrics.percent(F.col("successes"), F.col("calls")))

    def flush(self) -> None:
        """Write the open epoch's totals as a snapshot up to its last batch; without a new batch there is nothing to do."""
        epoch = self.epoch()
        batches = [int(n.split("-")[1]) for n in self._folders("log") if n.startswith(f"{epoch:08d}-")]
        if batches and max(batches) > self._snapshot(epoch)[1]:
            self.load().drop("success_pct").write.mode("overwrite").parquet(f"{self.root}/snapshot/{epoch:08d}-{max(batches):012d}")

    def follow(self, runs: DataFrame, checkpoint: str, every: str | None = "30 seconds", flush_every: int = 10) -> StreamingQuery:
        """Log a stream of runs, a batch ``every`` so often (all there is, if None), with a snapshot each ``flush_every``
        batches. A batch that was cut off is run again by its number, so none is lost and none counts twice."""

        def put(batch: DataFrame, number: int) -> None:
            self.append(batch, number)
            if number % flush_every == flush_every - 1:
                self.flush()

        writer = runs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def export(self) -> str:
        """The open epoch's totals as one JSON text, agents in order: what a dashboard shows, an agent a row."""
        return json.dumps([r.asDict() for r in self.load().orderBy("agent").collect()])
