"""Metrics that survive a killed run, and table functions in SQL."""

import json

import pytest

from corpusloom.operators import generators
from corpusloom.streaming.metric_log import RUNS, MetricLog


def totals(log):
    return {r.agent: (r.calls, r.total_ms, r.successes, r.failures) for r in log.load().collect()}


def test_load_merges_snapshot_and_tail(spark, tmp_path):
    log = MetricLog(spark, str(tmp_path / "m"))
    runs = lambda *rows: spark.createDataFrame(list(rows), RUNS)
    assert totals(log) == {} and log.epoch() == 0
    log.flush()
    log.append(runs(("a", 1.0, True), ("a", 2.0, False)), 0)
    log.flush()
    log.append(runs(("a", 3.0, True), ("b", 1.0, True)), 1)
    log.append(runs(("a", 3.0, True), ("b", 1.0, True)), 1)  # the batch is run again
    assert totals(log) == {"a": (3, 6.0, 2, 1), "b": (1, 1.0, 1, 0)}
    assert totals(MetricLog(spark, log.root)) == totals(log)  # another session loads the same
    log.flush(), log.flush()
    assert totals(log) == {"a": (3, 6.0, 2, 1), "b": (1, 1.0, 1, 0)} and len(log._folders("snapshot")) == 2
    assert json.loads(log.export())[1] == {"agent": "b", "calls": 1, "total_ms": 1.0, "successes": 1, "failures": 0, "success_pct": 100.0}
    assert log.reset() == 1 and totals(log) == {}
    log.append(runs(("c", 5.0, False)), 2)
    assert totals(log) == {"c": (1, 5.0, 0, 1)}


def test_a_killed_run_loses_nothing(spark, tmp_path, monkeypatch):
    log, source, checkpoint = MetricLog(spark, str(tmp_path / "m")), str(tmp_path / "in"), str(tmp_path / "cp")
    for i in range(4):
        spark.createDataFrame([("a", float(i), i % 2 == 0)], RUNS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(source)
    whole = MetricLog.append

    def dies(self, runs, batch):
        whole(self, runs, batch)
        if batch == 2:
            raise RuntimeError("killed after writing")

    monkeypatch.setattr(MetricLog, "append", dies)
    with pytest.raises(Exception, match="killed"):
        log.follow(stream, checkpoint, None, 2).awaitTermination(180)
    monkeypatch.setattr(MetricLog, "append", whole)
    log.follow(stream, checkpoint, None, 2).awaitTermination(180)
    assert totals(log) == {"a": (4, 6.0, 2, 2)} and len(log._folders("snapshot")) == 2


def test_table_functions(spark):
    generators.register(spark)
    rows = spark.createDataFrame([(1, "a1b22"), (2, None), (3, "")], "id int, t string")
    got = spark.sql(r"SELECT id, m.* FROM {rows} r, LATERAL matches(r.t, r'([a-z])(?P<n>\d+)') m", rows=rows)
    assert got.columns == ["id", "position", "match", "g1", "n"] and [tuple(r) for r in got.orderBy("position").collect()] == [(1, 0, "a1", "a", "1"), (1, 2, "b22", "b", "22")]
    for form in ("r'('", "concat('a', t)"):
        with pytest.raises(Exception, match="pattern"):
            spark.sql(f"SELECT m.* FROM {{rows}} r, LATERAL matches(r.t, {form}) m", rows=rows).collect()
    at = spark.createDataFrame([("k", 1), ("k", 4), ("k", 4), ("k", None), ("j", 7)], "key string, at long")
    assert [tuple(r) for r in spark.sql("SELECT * FROM gaps(TABLE({at}))", at=at).collect()] == [("k", 2, 3)]
    with pytest.raises(Exception, match="table"):
        spark.sql("SELECT * FROM gaps(1)").collect()
