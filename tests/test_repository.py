"""The data source for file trees."""

import os

from corpusloom.operators import layers
from corpusloom.sources import repository


def tree(root, files):
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(t.encode() if isinstance(t, str) else t)


def test_prunes_folders_and_reads_only_what_it_needs(spark, tmp_path):
    files = {"src/a.ts": "export function a() {}", "src/deep/er/b.ts": "import { a } from '../../a';", "node_modules/x/c.ts": "no", "yarn.lock": "no", "db/s.sql": "CREATE TABLE t", "README.md": "# hi", "src/.git/d.ts": "no", "bad.py": b"\xff\xfe x"}
    tree(tmp_path, files)
    os.mkfifo(tmp_path / "node_modules" / "hangs.ts")  # opened, it would never end
    os.mkfifo(tmp_path / "pipe.ts")
    os.symlink(tmp_path / "src", tmp_path / "again")
    os.symlink(tmp_path / "src" / "a.ts", tmp_path / "link.ts")
    for parts in (1, 3, 50):
        df = repository.read(spark, str(tmp_path), parts)
        got = {r.path: (r.kind, r.content, r.error) for r in df.collect()}
        assert df.count() == len(got) and got == {
            "src/a.ts": ("source", files["src/a.ts"], None), "src/deep/er/b.ts": ("source", files["src/deep/er/b.ts"], None), "db/s.sql": ("schema", "CREATE TABLE t", None), "README.md": ("other", None, None), "bad.py": ("source", "�� x", None),
        }
    graph = layers.graph_from_files(repository.readable(df).drop("bytes"))
    assert ("file:src/deep/er/b.ts", "function:src/a.ts:a", "imports") in {(r.source, r.target, r.type) for r in graph.edges.collect()}
    (tmp_path / "empty").mkdir()
    assert repository.read(spark, str(tmp_path / "empty")).count() == 0


def test_parts_share_files_and_folders(tmp_path):
    tree(tmp_path, {f"d{i}/e{j}/f.ts": "x" * (i + 1) for i in range(6) for j in range(6)} | {f"top{i}.ts": "y" * 100 * i for i in range(8)})
    parts = repository.RepositoryReader(str(tmp_path), 4).partitions()
    assert len(parts) == 4 and sum(len(p.files) for p in parts) == 8 and sum(len(p.folders) for p in parts) == 36
    sizes = [sum(n for _, n in p.files) for p in parts]
    assert max(sizes) <= 2 * sum(sizes) / 4


class Broken:
    """A store that lists a file it can't open."""

    def __init__(self, disk):
        self.disk = disk

    def get_file_info(self, selector):
        if "locked" in selector.base_dir:
            raise PermissionError("no entry")
        return self.disk.get_file_info(selector)

    def open_input_file(self, path):
        if "secret" in path:
            raise PermissionError("no reading")
        return self.disk.open_input_file(path)


def test_unreadable_files_and_folders_are_rows(spark, tmp_path, monkeypatch):
    tree(tmp_path, {"a/secret.ts": "x", "a/b.ts": "y", "locked/c.ts": "z"})
    reader = repository.RepositoryReader(str(tmp_path), 1)
    disk, base = reader._open()
    monkeypatch.setattr(reader, "_open", lambda: (Broken(disk), base))
    part = repository.Part((f"{base}/a", f"{base}/locked"), ())
    rows = {r[0]: r for r in reader.read(part)}
    assert rows["a/b.ts"][3:] == ("y", None) and rows["a/secret.ts"][3] is None and "no reading" in rows["a/secret.ts"][4] and "no entry" in rows["locked"][4]
    df = spark.createDataFrame(list(rows.values()), repository.SCHEMA)
    assert {r.path for r in repository.skipped(df).collect()} == {"a/secret.ts", "locked"} and [r.path for r in repository.readable(df).collect()] == ["a/b.ts"]
