"""Size-tiered compaction of immutable shards under a versioned manifest."""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import remove


#: Schemes of stores without a rename in one step, where a created object shows when it is whole. Their client has to create
#: conditionally (s3a: conditional writes on, as newer Hadoop has them), else two writers may take one version. Stores
#: whose files show while they are written, such as abfs, rename in one step and are none of these.
OBJECT_STORES = ("s3a", "gs", "oss", "cosn")


@dataclass(frozen=True)
class Shard:
    name: str
    seq: int
    bytes: int
    files: int


class ShardStore:
    """A folder of immutable Parquet shards and one JSON manifest a version.

    A commit writes the new manifest under a name of its own and gives it the name ``v<n>.json`` in one step that fails
    if another writer took that version: by a hard link on a local file system, by a rename that never replaces on HDFS
    and its like (abfs too), by a conditional create on object stores. So a version is either wholly there or not at all, and of
    two writers one is told to retry. Readers see the shards of one version; files that no manifest names (of a job
    that died) are never read, and go at a ``vacuum`` once they are old enough.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        return max(self._versions(), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def _commit(self, shards: list[Shard], base: int) -> int:
        version = base + 1
        final, temp = (self._path(f"{self.root}/manifest/{n}") for n in (f"v{version:08d}.json", f".{uuid.uuid4().hex}"))
        text = bytearray(json.dumps({"version": version, "shards": [asdict(s) for s in sorted(shards, key=lambda s: s.seq)]}).encode())
        try:
            if self._fs.getUri().getScheme() in OBJECT_STORES:  # a created object shows when it is whole, and only one creation wins
                self._put(final, text)
            else:
                self._put(temp, text)
                try:
                    self._publish(temp, final)
                finally:
                    self._fs.delete(temp, False)
        except (Py4JJavaError, FileExistsError) as e:
            if not self._fs.exists(final):
                raise
            raise RuntimeError(f"version {version} was committed by another writer; read again and retry") from e
        return version

    def _put(self, path, text: bytearray) -> None:
        out = self._fs.create(path, False)
        out.write(text)
        out.close()

    def _publish(self, temp, final) -> None:
        """Give a whole file its final name unless that is taken, in one step."""
        if self._fs.getUri().getScheme() == "file":
            os.link(temp.toUri().getPath(), final.toUri().getPath())
            return
        jvm = self.spark._jvm
        options = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, final, options)

    def _measure(self, name: str, seq: int) -> Shard:
        files = [s for s in self._fs.listStatus(self._path(f"{self.root}/data/{name}")) if s.getPath().getName().startswith("part-")]
        return Shard(name, seq, sum(s.getLen() for s in files), len(files))

    def append(self, df: DataFrame, by: str | None = None) -> int:
        """Commit ``df`` as one new shard, or, with ``by``, one after another as a shard for each value of that column, all
        written by one job. An empty ``df`` with ``by`` gives no shard; rows, nulls and repeats stay as they are."""
        base, job = self.version(), uuid.uuid4().hex
        have = self.shards(base)
        seq = max((s.seq for s in have), default=-1) + 1
        if by is None:
            df.write.parquet(f"{self.root}/data/{job}")
            names = [job]
        else:
            df.write.partitionBy(by).parquet(f"{self.root}/data/{job}")
            names = sorted(f"{job}/{s.getPath().getName()}" for s in self._fs.listStatus(self._path(f"{self.root}/data/{job}")) if s.isDirectory())
        for i, n in enumerate(names):
            have = have + [self._measure(n, seq + i)]
            base = self._commit(have, base)
        return base

    def compact(self, target_bytes: int = 128 << 20, fanout: int = 4, smallest: int = 1 << 20) -> int:
        """Merge runs of at least ``fanout`` neighbouring shards of one size tier, until no tier holds such a run.

        A tier spans a factor of ``fanout`` in bytes; shards whose files average half the target or more are full and
        stay. A run is merged by one distributed job without a shuffle into files of about ``target_bytes``. Returns
        the version; unchanged if nothing could be merged.
        """
        while True:
            base = self.version()
            shards = self.shards(base)
            run = self._run(shards, target_bytes, fanout, smallest)
            if not run:
                return base
            name = uuid.uuid4().hex
            size = sum(s.bytes for s in run)
            rows = self.spark.read.parquet(*[f"{self.root}/data/{s.name}" for s in run])
            rows.coalesce(max(1, math.ceil(size / target_bytes))).write.parquet(f"{self.root}/data/{name}")
            self._commit([s for s in shards if s not in run] + [self._measure(name, run[0].seq)], base)

    @staticmethod
    def _run(shards: list[Shard], target: int, fanout: int, smallest: int) -> list[Shard]:
        run: list[Shard] = []
        tier = lambda s: int(math.log(max(s.bytes, smallest) / smallest, fanout) + 1e-9)
        for s in sorted(shards, key=lambda s: s.seq):
            if s.bytes / max(1, s.files) >= target / 2:
                if len(run) >= fanout:
                    return run
                run = []
            elif run and tier(run[0]) != tier(s):
                if len(run) >= fanout:
                    return run
                run = [s]
            else:
                run.append(s)
        return run if len(run) >= fanout else []

    def vacuum(self, hours: float = 24.0) -> None:
        """Remove what is over ``hours`` old and what the newest version does not name: shards, files of jobs that died,
        and older manifests. Younger files stay, as readers of an older version or an unfinished writer may need them."""
        now, limit = self.version(), (time.time() - 3600 * hours) * 1000
        old = lambda s: s.getModificationTime() <= limit
        stale = [v for v in self._versions() if v < now and old(self._fs.getFileStatus(self._path(f"{self.root}/manifest/v{v:08d}.json")))]
        for v in stale:
            remove(self.spark, f"{self.root}/manifest/v{v:08d}.json")
        named = {s.name for v in self._versions() for s in self.shards(v)}
        data = self._path(f"{self.root}/data")
        for top in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = top.getPath().getName()
            if name in named or not old(top):
                continue
            inner = [f"{name}/{s.getPath().getName()}" for s in self._fs.listStatus(top.getPath())]
            for x in [n for n in inner if n not in named] if any(n in named for n in inner) else [name]:
                remove(self.spark, f"{self.root}/data/{x}")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version with the shard of each; null for a store without shards."""
        shards = self.shards(version)
        if not shards:
            return None
        rows = self.spark.read.parquet(*[f"{self.root}/data/{s.name}" for s in shards])
        return rows.withColumn("shard_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def ingest(docs: DataFrame, root: str, arrivals: int = 16, target_bytes: int = 128 << 20, fanout: int = 4, hours: float = 24.0) -> ShardStore:
    """Append ``docs`` as ``arrivals`` small shards, a version each, compact them, and vacuum what is over ``hours`` old; the
    newest version holds every row once.

    Nulls and repeated rows are kept as they are; an empty table gives a store without shards.
    """
    store = ShardStore(docs.sparkSession, root)
    batch = F.pmod(F.xxhash64(*[c for c in ("doc_id",) if c in docs.columns]), F.lit(arrivals)).cast("int")
    store.append(docs.withColumn("__arrival", batch), by="__arrival")
    store.compact(target_bytes, fanout)
    store.vacuum(hours)
    return store
