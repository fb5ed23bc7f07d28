"""Tables in the folder that all executors share, and size checks before a broadcast."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_paths: list[str] = []
_tables: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a temporary one only where none is set and the
    session runs in one process. On a cluster without one, raises ValueError."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    if not _paths:
        atexit.register(_clean, spark)
    _paths.append(f"{shared_root(spark)}/corpusloom/{uuid.uuid4().hex}/{name}")
    return _paths[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, so any store that Spark reads works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):
        for table in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path in _paths:
            remove(spark, path.rsplit("/", 1)[0])


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """``store`` as a table of as many buckets by ``by`` as the session shuffles to, sorted within them: a join on that
    column reads it where it lies, without an exchange, as often as it is joined."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"corpusloom_{name}_{uuid.uuid4().hex}"
    df.repartition(n, by).write.option("path", scratch(spark, name)).bucketBy(n, by).sortBy(by).saveAsTable(table)
    _tables.append(table)
    return spark.table(table)


def held() -> int:
    """How many tables of the shared folder there are: what ``settle`` counts from."""
    return len(_paths)


def settle(df: DataFrame, name: str, since: int) -> DataFrame:
    """``store``, then remove the tables made after ``since``: those that only led to this one."""
    out = store(df, name)
    for path in _paths[since:-1]:
        remove(df.sparkSession, path.rsplit("/", 1)[0])
    del _paths[since:-1]
    return out


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that many of them."""
    return df.limit(rows + 1).count() <= rows


def offer(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df
