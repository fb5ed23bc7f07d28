"""Edges said of one row are those that joins give, and files meet in a few narrow exchanges, never with their texts."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import build, extract, incremental, layers, outline, owned
from corpusloom.plans.code_files import code_files
from corpusloom.shared import store

DIR = "/root/testdata/sf0.001"
SCHEMA = "path string, content string"
PATHS = ["src/a.ts", "src/b.tsx", "src/b.ts", "src/c/index.ts", "src/d.js", "src/a.test.ts", "tests/e.ts", "tests/f.ts", "x:y/g.ts", "src/h.go", "src/J.java", "py/k.py", "src/l.txt", "src/empty.ts", "sp ace/m.ts", "src/n.ts"]
SOURCES = ["./a", "./b", "./b.tsx", "./b.js", "./c", "./d", "./a.test", "../tests/e", "../src/a", "../src/b", "../x:y/g", "./g", "../sp ace/m", "./none", "express", "./h", ".", "./n"]
NAMES = ["one", "Two", "three", "Four", "five"]


def text(rng):
    n = lambda: rng.choice(NAMES)
    lines = []
    for _ in range(rng.randrange(7)):
        clause = rng.choice([f"{{ {n()}, {n()} as q }}", f"* as {n()}", n(), f"{n()}, {{ {n()} }}", "{ }", f"type {{ {n()} }}"])
        lines.append(rng.choice([f"import {clause} from '{rng.choice(SOURCES)}';", f"import '{rng.choice(SOURCES)}';"]))
    for _ in range(rng.randrange(5)):
        lines.append(f"{rng.choice(['', 'export ', 'export default '])}function {n()}() {{ {' '.join(f'{n()}();' for _ in range(rng.randrange(4)))} }}")
    for _ in range(rng.randrange(4)):
        lines.append(f"{rng.choice(['', 'export '])}class {n()} {rng.choice(['', f'extends {n()}'])} {rng.choice(['', f'implements {n()}, {n()}'])} {{ }}")
    lines += [rng.choice([f"app.use({n()});", "app.get('/x', f);", "app.Get(`/x`, f);", "@Post('/y')", "bus.on('t', f);", "bus.emit('t');", "bus.emit('');", "a.query(1);", ".query(1)", "fs.readFile(x); fs.promises.rm(x); fs.other(x)", "export const v = 1;"]) for _ in range(rng.randrange(8))]
    rng.shuffle(lines)
    return "\n".join(lines)


def repository(spark):
    """Small repositories, each in its folder."""
    files = {}
    for seed in range(12):
        rng = random.Random(seed)
        some = {p: text(rng) for p in PATHS if rng.random() < 0.9}
        some |= {"src/h.go": "package p\nimport (\n\t\"fmt\"\n\t\"./a\"\n)\nfunc One() {}\ntype Two struct {\n}\n", "src/J.java": "import java.util.*;\npublic class Two {\n}\n", "py/k.py": "from . import z\nfrom .z import one, Two as q\nclass Two(three): pass\ndef one(): app.use(one)\napp.get('/p', 1)\n", "py/z.py": "def (", "src/empty.ts": None}
        files |= {f"r{seed}/{p}": t for p, t in some.items()}
    return spark.createDataFrame(list(files.items()), SCHEMA)


def by_joins(files):
    """The edges of files by one join for each relation and name."""
    facts = store(outline.facts(files), "facts")
    s = layers.scope(facts)
    out = build.contains_edges(s.symbols).unionByName(build.import_edges(s.items, s.imports, s.symbols)).unionByName(build.export_edges(facts.select("path", F.explode("exports").alias("e")).select("path", "e.name", "e.kind")))
    for refs, kind, type_ in ((layers.calls, "function", "calls"), (layers.parents, "class", "inherits"), (layers.interfaces, "class", "implements")):
        out = out.unionByName(build.reference_edges(refs(facts), kind, s.symbols, s.imported, type_, 0.9))
    out = out.unionByName(build.tested_by(s.imports)).unionByName(build.depends_on(s.imports))
    for e in (layers.Routes(), layers.Events(), layers.Middleware(), layers.DataAccess()):
        out = out.unionByName(e.enrich(None, {"scope": s, "sources": files})[1].drop("id"))
    return sorted(tuple(r) for r in out.select("source", "target", "type", "weight").collect())


def test_as_by_joins(spark, tmp_path):
    files = repository(spark)
    want = by_joins(files)
    assert sorted(tuple(r) for r in incremental.start(files, str(tmp_path / "s")).edges().collect()) == want
    assert len({t for _, _, t, _ in want}) == 14


def shuffled(df):
    """The columns of every exchange that a query makes."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("== Initial Plan ==")[-1].splitlines() if "Exchange hashpartitioning" in line or "Exchange SinglePartition" in line]


def test_a_state_is_made_of_texts_read_once_and_read_without_a_shuffle(spark, tmp_path, monkeypatch):
    reads = []
    files = store(code_files(spark, DIR), "files")
    counted = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(outline, "outlines", lambda df, keep=(), f=outline.outlines: reads.append(keep) or f(df, keep))
    read = F.udf(lambda x: counted.add(1) or x, "string").asNondeterministic()
    state = incremental.start(files.select("path", read("content").alias("content")), str(tmp_path / "s"))
    # a file by Python's parser or by the scanner: each filters its own
    assert reads == [("marks",)] and counted.value <= 2 * files.count()
    assert not shuffled(state.edges())
    assert spark.read.parquet(f"{state.root}/edges/version=0").count() == files.count()


def test_marks_as_each_form_alone(spark):
    texts = [(str(i), t) for i, t in enumerate(["app.get('/a', f); app.get('/a', f)", "x.on(\"e\"); on('f'); .emit(`g`)", "@Get('/h') @Use(x)", "server.use( cors ); app.use(a, b); app.use('x')", "fs.readFileSync(fs.writeFile, db . query(1)); db.query(2); fs.promises.read", "weird.get('a\"/b'); z.get(\"/it's\")", None, ""])]
    rows = {r.path: [tuple(m) for m in r.marks] for r in spark.createDataFrame(texts, SCHEMA).select("path", extract.marks(F.col("content")).alias("marks")).collect()}
    assert rows == {
        "0": [("route", "/a", "GET")] * 2, "1": [("event", "e", "subscribes"), ("event", "g", "publishes")], "2": [("route", "/h", "GET")], "3": [("use", "cors", "middleware")],
        "4": [("data", "database", "reads_from"), ("data", "filesystem", "reads_from"), ("data", "filesystem", "writes_to"), ("data", "filesystem", "reads_from")], "5": [], "6": [], "7": [],
    }
