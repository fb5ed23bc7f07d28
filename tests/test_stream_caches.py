"""Caches in the state of a stream, across a restart."""

import pytest

from corpusloom.streaming import caches


@pytest.fixture
def rocks(spark):
    spark.conf.set(*caches.STATE_STORE)
    yield spark
    spark.conf.unset(caches.STATE_STORE[0])


def run(spark, folder, make, schema, rows, name):
    """Feed ``rows`` as one more file, start the query from its checkpoint and stop it again."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    q = make(spark.readStream.schema(schema).parquet(str(folder / "in"))).writeStream.option("checkpointLocation", str(folder / "cp")).format("parquet").outputMode("append").trigger(availableNow=True).start(str(folder / name))
    q.awaitTermination(180)
    return [tuple(r) for r in spark.read.parquet(str(folder / name)).orderBy("seq").collect()]


def test_the_least_recently_used_goes(rocks, tmp_path):
    schema = "owner string, seq long, key string, value string"
    make = lambda s: caches.result_cache(s, 2)
    first = run(rocks, tmp_path, make, schema, [("o", 1, "a", "1"), ("o", 2, "b", "2"), ("o", 3, "a", None), ("p", 4, "a", None), ("o", 5, "a", "1b")], "out")
    assert first == [("o", 3, "hit", "a", "1"), ("p", 4, "miss", "a", None)]
    # the query starts again: a was used after b, so b goes
    every = run(rocks, tmp_path, make, schema, [("o", 9, "d", "4"), ("o", 6, "c", "3"), ("o", 7, "b", None), ("o", 8, "a", None)], "out")
    assert every[2:] == [("o", 6, "evict", "b", None), ("o", 7, "miss", "b", None), ("o", 8, "hit", "a", "1b"), ("o", 9, "evict", "c", None)]


def test_a_new_task_clears_the_search_cache(rocks, tmp_path):
    schema = "session string, seq long, task string, title string"
    first = run(rocks, tmp_path, caches.search_cache, schema, [("s", 1, "t1", "x"), ("s", 2, "t1", "y"), ("s", 3, "t1", None), ("s", 4, "t2", None)], "out")
    assert first == [("s", 3, "t1", ["x", "y"]), ("s", 4, "t2", [])]
    every = run(rocks, tmp_path, caches.search_cache, schema, [("s", 5, "t1", None), ("s", 6, "t2", "z"), ("s", 7, "t1", None), ("s", 8, "t2", None)], "out")
    assert every[2:] == [("s", 5, "t1", ["x", "y"]), ("s", 7, "t1", []), ("s", 8, "t2", ["z"])]
