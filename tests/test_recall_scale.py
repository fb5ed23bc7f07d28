"""Recall writes what it reaches, not the graph, and reaches what both traces do."""

from corpusloom.operators import propagation

NODES = [(f"n{i}", "file", f"src/n{i}" + (".test.ts" if i == 7 else ".ts")) for i in range(12)]
EDGES = [("n0", "n1", "calls", 0.9), ("n1", "n2", "calls", 0.9), ("n1", "n2", "calls", 0.9), ("n3", "n1", "imports", 0.7), ("n4", "n3", "calls", 0.9), ("n5", "n4", "calls", 0.9), ("n2", "n7", "calls", 0.9), ("n2", "n0", "contains", 1.0), ("n8", "n0", "calls", 0.2), ("n2", "nowhere", "calls", 0.9), ("n7", "n9", "calls", 0.9), ("n4", "n10", "depends_on", 0.5)]


def tables(spark, extra=0):
    nodes = spark.createDataFrame(NODES, "id string, type string, file_path string").union(spark.range(extra).selectExpr("concat('x', id)", "'file'", "'x'"))
    edges = spark.createDataFrame(EDGES, "source string, target string, type string, weight double").union(spark.range(extra).selectExpr("concat('x', id)", "concat('x', id + 1)", "'calls'", "0.9d"))
    return nodes, edges.selectExpr("concat_ws('--', source, type, target) as id", "source", "target", "type", "weight")


def test_as_both_traces(spark):
    nodes, edges = tables(spark)
    for starts in (["n0"], ["n3", "gone"], ["n7"], ["n2", "n5"]):
        entry = spark.createDataFrame([(x,) for x in starts], "id string")
        want = {x for x in starts if x != "gone"}
        for way in ("both", "upstream"):
            want |= {r.node_id for r in propagation.trace(nodes, edges, entry, way, 3, 0.5).affected.collect()}
        assert sorted(r.id for r in propagation.recall_context(nodes, edges, entry).collect()) == sorted(want)


def test_writes_what_it_reaches(spark, monkeypatch):
    wrote, store = [], propagation.store

    def counted(df, name):
        out = store(df, name)
        wrote.append(out.count())
        return out

    monkeypatch.setattr(propagation, "store", counted)
    nodes, edges = tables(spark, 3000)
    assert propagation.recall_context(nodes, edges, spark.createDataFrame([("n0",)], "id string")).count() > 1
    assert sum(wrote) < 100
