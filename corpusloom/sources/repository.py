"""A Python data source for file trees: folders are pruned before they are listed, contents read only where they are needed."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.model import IGNORED_DIRS, IGNORED_FILES, SOURCE_EXTENSIONS

SCHEMA = "path string, kind string, bytes long, content string, error string"
#: Files that aren't source, but whose content says something of a schema.
SCHEMA_FILES = (".sql", ".prisma")


@dataclass
class Part(InputPartition):
    """What one task reads: folders with all below them, and single files (path, bytes)."""

    folders: tuple[str, ...]
    files: tuple[tuple[str, int], ...]


def kind_of(path: str) -> str:
    """source, schema or other, by the extension."""
    ext = os.path.splitext(path)[1]
    return "source" if ext in SOURCE_EXTENSIONS else "schema" if ext.lower() in SCHEMA_FILES else "other"


class RepositoryReader(DataSourceReader):
    def __init__(self, root: str, parts: int):
        self.uri, self.parts = root, parts

    def _open(self) -> tuple[fs.FileSystem, str]:
        disk, base = fs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{os.path.abspath(self.uri)}")
        return disk, base.rstrip("/")

    def _list(self, disk: fs.FileSystem, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """The folders and the files of one folder that count; links, ignored names and what is neither are left out."""
        folders, files = [], []
        for info in sorted(disk.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
            name = info.path.rsplit("/", 1)[-1]
            if isinstance(disk, fs.LocalFileSystem) and os.path.islink(info.path):
                continue
            if info.type == fs.FileType.Directory and name not in IGNORED_DIRS:
                folders.append(info.path)
            elif info.type == fs.FileType.File and name not in IGNORED_FILES:
                files.append((info.path, info.size))
        return folders, files

    def partitions(self) -> list[Part]:
        """Level by level the driver lists folders until there are a few for each task, and no deeper: the rest is listed
        where it is read. Folders are dealt by a hash of their path, files by their bytes to the part that has least."""
        disk, base = self._open()
        level, loose = [base], []
        while level and len(level) < 4 * self.parts:
            below = []
            for folder in level:
                folders, files = self._list(disk, folder)
                below += folders
                loose += files
            level = below
        dealt: list[list[str]] = [[] for _ in range(self.parts)]
        for folder in level:
            dealt[int(hashlib.md5(folder.encode()).hexdigest(), 16) % self.parts].append(folder)
        files: list[list[tuple[str, int]]] = [[] for _ in range(self.parts)]
        held = [0] * self.parts
        for path, size in sorted(loose, key=lambda f: (-f[1], f[0])):
            at = held.index(min(held))
            files[at].append((path, size))
            held[at] += size + 4096
        return [Part(tuple(a), tuple(b)) for a, b in zip(dealt, files, strict=True) if a or b] or [Part((), ())]

    def read(self, partition: Part) -> Iterator[tuple]:
        """A row a file; one that can't be read has its error instead of its content, and the scan goes on."""
        disk, base = self._open()
        todo = list(partition.folders)
        yield from (self._row(disk, base, *f) for f in partition.files)
        while todo:
            folder = todo.pop()
            try:
                folders, files = self._list(disk, folder)
            except OSError as e:
                yield folder[len(base) + 1 :], "folder", None, None, f"{type(e).__name__}: {e}"
                continue
            todo += folders
            yield from (self._row(disk, base, *f) for f in files)

    def _row(self, disk: fs.FileSystem, base: str, path: str, size: int) -> tuple:
        kind, name = kind_of(path), path[len(base) + 1 :]
        if kind == "other":
            return name, kind, size, None, None
        try:
            with disk.open_input_file(path) as f:
                return name, kind, size, f.read().decode("utf-8", "replace"), None
        except OSError as e:
            return name, kind, size, None, f"{type(e).__name__}: {e}"


class RepositorySource(DataSource):
    """``spark.read.format("repository").option("parts", n).load(root)``: (path, kind, bytes, content, error) of every file
    under a folder of any store that pyarrow opens."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(self.options["path"], int(self.options.get("parts", "8")))


def read(spark: SparkSession, root: str, parts: int | None = None) -> DataFrame:
    """The files under ``root``, read by ``parts`` tasks (as many as the session has cores, if none is named)."""
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repository").option("parts", parts or spark.sparkContext.defaultParallelism).load(root)


def skipped(files: DataFrame) -> DataFrame:
    """(path, error) of what couldn't be read."""
    return files.where("error is not null").select("path", "error")


def readable(files: DataFrame, kind: Column | str = "source") -> DataFrame:
    """(path, content, bytes) of the files of a kind that were read."""
    return files.where((F.col("kind") == kind) & F.col("error").isNull()).select("path", "content", "bytes")
