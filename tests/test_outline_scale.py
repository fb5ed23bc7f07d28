"""Names in arguments stand alone, and outlines come in batches of many files."""

from corpusloom.operators.outline import facts, outlines


def test_a_call_in_the_arguments_of_a_call(spark):
    files = [("a.ts", "function f(a) {\n  one(two(a), [three({ x: four() })]);\n  five(`${six(a)}`)(7);\n}\n")]
    assert facts(spark.createDataFrame(files, "path string, content string")).first().functions[0].calls == ["one", "two", "three", "four", "five", "six"]


def test_files_share_batches(spark):
    files = spark.range(0, 200, 1, 1).selectExpr("concat('f', id, '.ts') as path", "if(id % 3 = 0, '', concat('export function g', id, '() { h(''', id, ''') }')) as content")
    sizes = outlines(files).mapInArrow(lambda batches: (b.select(["total_lines"]).slice(0, 1) for b in batches), "total_lines int")
    assert sizes.count() == 1
    assert {r.path: [(f.name, f.calls) for f in r.functions] for r in facts(files).collect()} == {f"f{i}.ts": [(f"g{i}", ["h"])] if i % 3 else [] for i in range(200)}
