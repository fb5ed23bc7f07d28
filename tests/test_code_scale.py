"""Source files are dealt evenly to tasks, import targets are as step by step, and levels make no edges; the graph reads texts from a table."""

from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.operators import incremental
from corpusloom.plans import build_queries, code_queries
from corpusloom.plans.code_files import code_files

DIR = "/root/testdata/sf0.001"


def test_files_are_dealt_to_all_tasks(spark):
    sizes = [n for n in code_files(spark, DIR).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * min(sizes)


def test_targets_as_step_by_step(spark):
    paths = ["a.ts", "src/a.ts", "src/b/c/d.ts", "/abs/x.ts", "./src/a.ts", "src//b/a.ts", "src/../b/a.ts", "..x/.y/a.ts", None]
    sources = ["./a", "../a", "../../a.js", "../../../../a", ".././../a", "./../a/b", "../a/../b", "./a//b", "..", ".", "./", "../", ".hid/x", "..two/x", "../.../x", "./a/.", "./..", ".//a", None]
    rows = spark.createDataFrame([(p, s) for p in paths for s in sources], "path string, source string")
    rows = rows.select("path", "source", P.joined(F.col("path"), F.col("source")).alias("found"), P.normalise(F.concat(P.dirname(F.col("path")), F.lit("/"), F.col("source"))).alias("want"))
    assert rows.where("not found <=> want").collect() == []


def test_levels_make_no_edges(spark, monkeypatch):
    monkeypatch.setattr(incremental, "owned_edges", None)
    assert code_queries.code_sync_levels(spark, DIR).count() == 4


def test_only_facts_asked_for_are_made(spark, monkeypatch):
    wrote, store = [], build_queries.store
    monkeypatch.setattr(build_queries, "store", lambda df, name: wrote.append(df.columns) or store(df, name))
    build_queries.depends_on(spark, DIR)
    build_queries.call_edges(spark, DIR)
    assert wrote == [["path", "imports"], ["path", "functions", "classes", "imports"]]


def test_graph_reads_texts_from_a_table(spark, monkeypatch):
    read, made = [], code_queries.layers.graph_from_files
    monkeypatch.setattr(code_queries.layers, "graph_from_files", lambda files, only: read.append(files.inputFiles()) or made(files, only))
    code_queries.graph(spark, DIR)
    assert not any(DIR in f for f in read[0])
