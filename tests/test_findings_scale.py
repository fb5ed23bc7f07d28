"""What keeps the findings' steps within bounds as the files grow."""

from corpusloom import catalog
from corpusloom.operators import findings


def test_words_of_files_are_not_broadcast(spark, tmp_path):
    """Over a table, whose size the planner knows, and takes for that of the words exploded from it."""
    files = [("a.ts", "let x = 1;\nconst y = 2;\ny.run();\nif (z) z.go();\nw.stop();\n")]
    spark.createDataFrame(files, "path string, content string").write.parquet(f"{tmp_path}/files")
    found = findings.rule_scan(spark.read.parquet(f"{tmp_path}/files"))
    assert {(r.description.split(" may")[0].split(": ")[1], r.line) for r in found.collect()} == {("x", 1), ("y", 3), ("w", 5)}
    for df in (found, catalog.QUERIES["rule_scan"](spark, "/root/testdata/sf0.001")):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
