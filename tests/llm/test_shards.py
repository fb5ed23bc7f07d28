import json
import os
import threading

import pytest

from corpusloom.llm import shards
from tests.llm import awkward


def rows(df):
    return sorted((tuple(r)[: len(awkward.DOCS.split(", "))] for r in df.collect()), key=repr)


def test_content_survives_compaction(spark, tmp_path):
    docs = awkward.documents(spark)
    store = shards.ingest(docs, str(tmp_path / "s"), arrivals=9, target_bytes=1 << 20)
    assert rows(store.read()) == rows(docs) and len(store.shards()) < 9
    assert [s for s in store.shards()] == [s for s in shards.ShardStore(spark, str(tmp_path / "s")).shards()]


def test_versions_are_whole_and_immutable(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    for i in range(5):
        store.append(spark.range(i * 10, i * 10 + 10))
    assert store.version() == 5 and store.read(3).count() == 30 and store.read().count() == 50
    store.compact(target_bytes=1 << 20, fanout=4)
    assert store.version() == 6 and len(store.shards()) == 1 and store.read().count() == 50 and store.read(5).count() == 50
    store.compact()
    assert store.version() == 6
    orphan = str(tmp_path / "s/data/orphan")
    spark.range(3).write.parquet(orphan)
    assert store.read().count() == 50
    store.vacuum()
    assert os.path.exists(orphan) and store._versions() == [1, 2, 3, 4, 5, 6] and store.read(5).count() == 50
    store.vacuum(hours=0)
    assert not os.path.exists(orphan) and store.read().count() == 50 and store._versions() == [6]


def test_two_writers(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    store.append(spark.range(3))
    with pytest.raises(RuntimeError):
        store._commit([], 0)
    assert store.version() == 1 and json.load(open(tmp_path / "s/manifest/v00000001.json"))["version"] == 1


def test_concurrent_writers(spark, tmp_path):
    root = str(tmp_path / "s")
    shards.ShardStore(spark, root).append(spark.range(1))
    won, lost = [], []

    def write(i):
        store = shards.ShardStore(spark, root)
        try:
            won.append(store._commit(store.shards(1) + [shards.Shard(f"w{i}", i, 1, 1)], 1))
        except RuntimeError:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = shards.ShardStore(spark, root)
    assert won == [2] and len(lost) == 7 and store._versions() == [1, 2] and len(store.shards()) == 2
    assert sorted(os.listdir(f"{root}/manifest")) == sorted(n for n in os.listdir(f"{root}/manifest") if n.endswith(".json") and n.startswith(("v", ".v")) or n.endswith(".crc"))


def test_arrivals_are_versions(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    store.append(spark.range(100).selectExpr("id", "id % 5 as batch"), by="batch")
    assert store.version() == 5 and [store.read(v).count() for v in range(1, 6)] == [20, 40, 60, 80, 100]


def test_runs():
    mb = 1 << 20
    s = lambda seq, size, files=1: shards.Shard(f"s{seq}", seq, size * mb, files)
    run = lambda xs: [x.seq for x in shards.ShardStore._run(xs, 128 * mb, 4, mb)]
    assert run([s(i, 2) for i in range(3)]) == [] and run([s(i, 2) for i in range(4)]) == [0, 1, 2, 3]
    assert run([s(0, 60), s(1, 2), s(2, 2), s(3, 2), s(4, 3)]) == [1, 2, 3, 4]
    assert run([s(0, 2), s(1, 2), s(2, 100), s(3, 2), s(4, 2)]) == []


def test_empty_table(spark, tmp_path):
    assert (shards.ingest(awkward.documents(spark).limit(0), str(tmp_path / "s")).read() or spark.range(0)).count() == 0
