import pytest
from pyspark.sql import functions as F

from corpusloom.sources import corpus
from corpusloom.streaming import jobs


def test_scan(spark, tmp_path):
    for p, t in {"src/a.ts": "export const x = 1", "node_modules/b.ts": "no", "yarn.lock": "no", "db/s.sql": "CREATE TABLE t", "README.md": "# hi", "deep/er/c.py": "x = 1"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    assert {r.path: r.content for r in corpus.scan(spark, str(tmp_path)).collect()} == {"src/a.ts": "export const x = 1", "deep/er/c.py": "x = 1"}
    assert {r.path: (r["class"], r.content) for r in corpus.assets(spark, str(tmp_path)).collect()} == {"db/s.sql": ("schema", "CREATE TABLE t"), "README.md": ("document", None)}


def test_bad_tasks_raise(spark):
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        corpus.tasks(spark.createDataFrame([("{broken",)], "value string")).collect()


def feed(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_running_counters(spark, tmp_path):
    s = feed(spark, tmp_path, [[("a", 1.0, True)], [("a", 2.0, False), ("b", 1.0, True)]], "agent string, ms double, success boolean")
    q = jobs.counters(s).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.agent, r.calls, r.failures) for r in spark.table("counts").collect()} == {("a", 2, 1), ("b", 1, 0)}


def test_budget_state(spark, tmp_path):
    s = feed(spark, tmp_path, [[(1, 60)], [(1, 30), (2, 5)], [(1, -4)]], "task long, tokens long")
    q = jobs.budget(s, 100).writeStream.outputMode("update").format("memory").queryName("budget").start()
    q.processAllAvailable()
    q.stop()
    used = {}
    for r in spark.table("budget").collect():
        used[r.task] = max(used.get(r.task, 0), r.used)
    assert used == {1: 90, 2: 5}


def test_recent_keys(spark, tmp_path):
    s = feed(spark, tmp_path, [[(1, "a", 1), (1, "b", 2)], [(1, "c", 3), (1, "a", 4)]], "task long, key string, seq long")
    q = jobs.recent(s, 2).writeStream.outputMode("update").format("memory").queryName("recent").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("recent").collect()
    assert {("a", 4), ("c", 3)} <= {(r.key, r.seq) for r in rows}


def test_upsert_by_batch(spark, tmp_path):
    s = feed(spark, tmp_path, [[("a", 1)], [("a", 2), ("b", 5)]], "id string, n long")
    merge = lambda new, old: (new if old is None else old.unionByName(new)).groupBy("id").agg(F.sum("n").alias("n"))
    q = jobs.upsert(s, str(tmp_path / "t"), str(tmp_path / "cp"), merge)
    q.awaitTermination(120)
    assert {(r.id, r.n) for r in jobs.newest(spark, str(tmp_path / "t"), 2).collect()} == {("a", 3), ("b", 5)}


def test_windows_and_first_seen(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 2.0), ("2024-01-01 01:00:00", "b", 1.0)], "ts string, event_type string, value double")
    rows.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df in (("windows", jobs.windowed(s)), ("seen", jobs.first_seen(s, "event_type", "ts"))):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("seen").count() == 2
    assert {(r.event_type, r.n) for r in spark.table("windows").collect()} >= {("a", 2)}
