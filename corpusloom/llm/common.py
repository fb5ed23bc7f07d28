"""Shared helpers of the corpus operators: let-bindings, word splitting, and the tables of the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.shared import held, offer, remove, scratch, settle, small, store  # noqa: F401

#: The white space between words: space and the ASCII controls from tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a lambda variable: evaluated once a row, whatever the optimiser collapses."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array without empty items; null counts as empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that Spark wrote or reads, for workers, and the path in it.

    Workers open files through pyarrow, which knows s3a and s3n as s3; what it doesn't know raises ValueError.
    """
    scheme, found, rest = uri.partition("://")
    try:
        return fs.FileSystem.from_uri(f"s3://{rest}" if found and scheme in ("s3a", "s3n") else uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"workers can't open {uri}: name a folder of file, hdfs, s3, gs or abfs in spark.checkpoint.dir") from e


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt over as many tasks as the session shuffles to, however few bytes they hold: each row is much work."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(n, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over Arrow batches; at its end the worker gives its free memory back, as it may idle for long."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run
