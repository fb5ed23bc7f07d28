"""Source files made of the tables: each part is a file, each order's first two parts an import, and SQL says what they hold.

The texts put declarations over many lines and decoys into strings, templates and comments. The SQL never reads a text:
it says from the tables which nodes and edges the files must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.code_rows import FILES
from corpusloom.plans.registry import literal
from corpusloom.plans.tables import table


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _kind(p: Column) -> Column:
    return F.when(p % 10 == 8, "go").when(p % 10 == 9, "java").otherwise("ts")


def _stem(p: Column) -> Column:
    """The path without its extension."""
    return _text(F.when(p % 23 == 0, "tests").otherwise("src"), "/m", p % 17, "/part", p, F.when(p % 23 == 0, ".test").otherwise(""))


def path(p: Column) -> Column:
    return _text(_stem(p), ".", F.when(_kind(p) != "ts", _kind(p)).when(p % 3 == 0, "tsx").otherwise("ts"))


def relations(spark: SparkSession, d: str) -> DataFrame:
    """(p, q, k): the k-th part that a TypeScript file p imports."""
    lines = table(spark, d, "lineitem").where("l_linenumber <= 2")
    a = lines.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("p"))
    b = lines.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("q"))
    pairs = a.join(b, "l_orderkey").where((F.col("p") != F.col("q")) & (_kind(F.col("p")) == "ts")).groupBy("p").agg(F.array_sort(F.collect_set("q")).alias("qs"))
    return pairs.select("p", F.posexplode("qs").alias("k", "q")).select("p", "q", (F.col("k") + 1).alias("k"))


def code_files(spark: SparkSession, d: str, version: int = 0) -> DataFrame:
    """(path, content) of every part, dealt evenly to as many tasks as the session shuffles to: rows of keys are small, so by
    their bytes they would be put together in a few tasks, which then make and read all texts. Version 1 is a later state:
    every 19th part is gone, every 5th has another comment, and the exported function of every 7th has another name."""
    p, v = F.col("p_partkey"), F.lit(version)
    sources = relations(spark, d).groupBy("p").agg(F.array_sort(F.collect_list(F.struct("k", "q"))).alias("to"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, d, "part").select("p_partkey").repartition(n, "p_partkey").join(sources, p == F.col("p"), "left").withColumn("to", F.coalesce("to", F.array().cast("array<struct<k:int,q:int>>")))
    each = lambda f, sep: F.array_join(F.transform("to", lambda x: f(x["q"])), sep)
    spec = lambda q: _text("../../", _stem(q), F.when((q % 3 == 1) & (_kind(q) == "ts"), ".js").when((q % 3 == 2) & (_kind(q) == "ts"), ".ts").otherwise(""))
    made = _text(F.when((v == 1) & (p % 7 == 0), "made").otherwise("make"), p)
    first, second = F.get("to", F.lit(0))["q"], F.get("to", F.lit(1))["q"]
    imports = each(lambda q: _text("import {\n  make", q, " as build", q, ",\n  Part", q, ",\n} from '", spec(q), "';\n"), "")
    ts = _text(
        "/* function ghost", p, "() { return make1(); } */\n// import { nothing } from './nowhere';\nimport express from 'express';\n", imports, F.when(p % 5 == 0, _text("import './missing", p, "';\n")).otherwise(""),
        "\nexport class Part", p, F.when(first.isNotNull(), _text(" extends Part", first)).otherwise(""), "\n  implements Shape", p, F.when(second.isNotNull(), _text(", Part", second)).otherwise(""), " {\n  private size: number = 7;\n  label = \"function fake() { }\";\n",
        "  constructor(\n    readonly name: string,\n  ) { super(); }\n  total", p, "(a: number,\n        b: Map<string, number>): number {\n    return helper(a) + `x ${make1(1)} {`.length;\n  }\n}\n\nclass Shape", p, " {\n}\n\n",
        "export async function ", made, "(\n  a: number,\n  b = { x: 1, y: [2, 3] },\n  ...rest: string[]\n): Promise<void> {\n  // make0()\n", each(lambda q: _text("  make", q, "(a);\n"), ""), "  const s = 'local", p, "(1)';\n", F.when(p % 13 != 0, _text("  local", p, "(s);\n")).otherwise(""), "}\n\nfunction local", p, "(x) {\n  return x;\n}\n",
        F.when(p % 7 == 1, _text("app.use(local", p, ");\n")).when((p % 7 == 2) & first.isNotNull(), _text("app.use(make", first, ");\n")).when(p % 7 == 3, "app.use(unknown);\n").otherwise(""),
        F.when(p % 6 == 0, _text("router.get('/items/", p, "', (q) => q);\n")).when(p % 6 == 1, _text("@Post(\"/forms/", p, "\")\n")).otherwise("map.get('key');\n"),
        F.when(p % 4 == 0, _text("bus.on('topic", p % 9, "', run);\n")).when(p % 4 == 1, _text("bus.emit('topic", p % 8, "', 1);\n")).otherwise(""),
        F.when(p % 11 == 0, "const r = fs.readFileSync('a');\n").when(p % 11 == 1, "fs.promises.writeFile('a', r);\n").when(p % 11 == 2, "const rows = db.query('select 1');\n").otherwise(""),
    )
    go = _text("package main\n\nimport \"fmt\"\n\n// func Ghost() {}\nfunc Make", p, "(a int,\n\tb int) int {\n\treturn len(`func Fake() {`) + a\n}\n\ntype Part", p, " struct {\n\tName string\n}\n")
    java = _text("package shop;\n\nimport java.util.List;\n\npublic class Part", p, " {\n    private String name = \"class Fake { }\";\n\n    public Part", p, "(String name) {\n        this.name = name;\n    }\n\n    public List<String> find", p, "(\n        int a) {\n        return List.of();\n    }\n}\n")
    note = F.when((v == 1) & (p % 5 == 0), _text("// seen again\n")).otherwise("")
    out = rows.select(path(p).alias("path"), _text(F.when(_kind(p) == "go", go).when(_kind(p) == "java", java).otherwise(ts), note).alias("content"), "p_partkey")
    return out.where(~((v == 1) & (p % 19 == 0))).drop("p_partkey")


def asset_paths(spark: SparkSession, d: str, forms) -> DataFrame:
    """(path): each part under one of the forms of a path."""
    p = F.col("p_partkey")
    return table(spark, d, "part").select(_text("app", p, "/", F.get(F.array(*map(F.lit, forms)), (p % len(forms)).cast("int"))).alias("path"))


def schema_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): two tables of SQL or two models of Prisma for every fifth part."""
    p = F.col("p_partkey")
    of_sql = _text("CREATE TABLE part", p, " (id int);\ncreate  table if not exists \"stock", p, "\" (n int);\n")
    of_prisma = _text("model Part", p, " {\n  id Int\n}\nmodel  Stock", p, "{\n}\n")
    rows = table(spark, d, "part").where(p % 5 == 0)
    return rows.select(_text("db/part", p, F.when(p % 2 == 0, ".sql").otherwise(".prisma")).alias("path"), F.when(p % 2 == 0, of_sql).otherwise(of_prisma).alias("content"))


def line_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content) whose declarations stand on lines of their own: what line forms can read."""
    p = F.col("p_partkey")
    text = _text("export async function f", p, "(a, b) {\n}\nconst g", p, " = (x) => x;\nexport class K", p, " {\n}\nimport { a, b } from './m", p, "';\nimport z from 'z", p, "';\nexport const h", p, " = async function (q) {};\n")
    return table(spark, d, "part").select(_text("src/line", p, ".ts").alias("path"), text.alias("content"))


def python_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content) of Python; every tenth doesn't parse."""
    p = F.col("p_partkey")
    text = _text("import os, sys as s\nfrom .m", p, " import y, z\ntext = (\n    'def ghost(): pass')\nclass A", p, "(B):\n    def f(self, a):\n        return a\nasync def g", p, "(\n    q): pass\n")
    return table(spark, d, "part").select(_text("py/part", p, ".py").alias("path"), F.when(p % 10 == 7, "def (").otherwise(text).alias("content"))


def repositories(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): small repositories of the files of ``code_rows``, as many as the parts fill, each file with its part."""
    p, n = F.col("p_partkey"), len(FILES)
    at = (p % n).cast("int")
    one = lambda i: F.get(F.array(*[F.lit(f[i]) for f in FILES]), at)
    return table(spark, d, "part").select(_text("r", F.floor(p / n), "/", one(0)).alias("path"), _text(one(1), "// part ", p, "\n").alias("content"))


REPOSITORIES = f"files AS (SELECT 'r' || p_partkey // {len(FILES)} || '/' || {literal([f[0] for f in FILES])}[p_partkey % {len(FILES)} + 1] AS path, {literal([f[1] for f in FILES])}[p_partkey % {len(FILES)} + 1] || '// part ' || p_partkey || chr(10) AS content FROM part)"


def sql(version: int = 0, prefix: str = "") -> str:
    """Common table expressions: parts f (p, kind, path), relations r (p, q, k), and of ``version`` the nodes and edges."""
    live = "p % 19 <> 0" if version else "TRUE"
    made = "CASE WHEN f.p % 7 = 0 THEN 'made' ELSE 'make' END" if version else "'make'"
    kept = "q % 7 <> 0" if version else "TRUE"  # the imported function still has its name
    x = prefix
    return f"""{x}f AS (SELECT p, kind, CASE WHEN p % 23 = 0 THEN 'tests' ELSE 'src' END || '/m' || p % 17 || '/part' || p || CASE WHEN p % 23 = 0 THEN '.test' ELSE '' END AS stem, CASE WHEN p % 23 = 0 THEN 'tests' ELSE 'src' END || '/m' || p % 17 || '/part' || p || CASE WHEN p % 23 = 0 THEN '.test' ELSE '' END || '.' || CASE WHEN kind <> 'ts' THEN kind WHEN p % 3 = 0 THEN 'tsx' ELSE 'ts' END AS path, p % 23 = 0 AS test
  FROM (SELECT p_partkey AS p, CASE p_partkey % 10 WHEN 8 THEN 'go' WHEN 9 THEN 'java' ELSE 'ts' END AS kind FROM part) WHERE {live}),
{x}rall AS (SELECT p, q, row_number() OVER (PARTITION BY p ORDER BY q) AS k, '../../' || CASE WHEN q % 23 = 0 THEN 'tests' ELSE 'src' END || '/m' || q % 17 || '/part' || q || CASE WHEN q % 23 = 0 THEN '.test' ELSE '' END || CASE WHEN q % 10 IN (8, 9) THEN '' WHEN q % 3 = 1 THEN '.js' WHEN q % 3 = 2 THEN '.ts' ELSE '' END AS spec FROM (SELECT DISTINCT a.l_partkey AS p, b.l_partkey AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 WHERE a.l_partkey <> b.l_partkey AND a.l_partkey % 10 NOT IN (8, 9))),
{x}r AS (SELECT r.p, r.q, r.k, r.spec, a.path AS path, a.test AS test, b.path AS target, b.kind AS kind, b.test AS target_test FROM {x}rall r JOIN {x}f a ON a.p = r.p JOIN {x}f b ON b.p = r.q),
{x}gone AS (SELECT r.p, r.q, a.path AS path, r.spec AS source FROM {x}rall r JOIN {x}f a ON a.p = r.p WHERE r.q NOT IN (SELECT p FROM {x}f)),
{x}functions AS (SELECT path, CASE WHEN kind = 'go' THEN 'Make' || p ELSE {made} || p END AS name, TRUE AS exported FROM {x}f f WHERE kind <> 'java' UNION ALL SELECT path, 'local' || p, FALSE FROM {x}f f WHERE kind = 'ts'),
{x}classes AS (SELECT path, 'Part' || p AS name, TRUE AS exported FROM {x}f f UNION ALL SELECT path, 'Shape' || p, FALSE FROM {x}f f WHERE kind = 'ts'),
{x}modules AS (SELECT path, CASE kind WHEN 'ts' THEN 'express' WHEN 'go' THEN 'fmt' ELSE 'java.util.List' END AS source FROM {x}f UNION ALL SELECT path, './missing' || p FROM {x}f WHERE kind = 'ts' AND p % 5 = 0 UNION ALL SELECT path, source FROM {x}gone),
{x}routed AS (SELECT path, CASE p % 6 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, CASE p % 6 WHEN 0 THEN '/items/' ELSE '/forms/' END || p AS route FROM {x}f WHERE kind = 'ts' AND p % 6 < 2),
{x}topics AS (SELECT path, 'topic' || CASE p % 4 WHEN 0 THEN p % 9 ELSE p % 8 END AS event, CASE p % 4 WHEN 0 THEN 'subscribes' ELSE 'publishes' END AS type FROM {x}f WHERE kind = 'ts' AND p % 4 < 2),
{x}accesses AS (SELECT path, CASE WHEN p % 11 = 2 THEN 'database' ELSE 'filesystem' END AS resource, CASE WHEN p % 11 = 1 THEN 'writes_to' ELSE 'reads_from' END AS type FROM {x}f WHERE kind = 'ts' AND p % 11 < 3),
{x}used AS (SELECT path, 'function:' || path || ':local' || p AS target FROM {x}f WHERE kind = 'ts' AND p % 7 = 1 UNION ALL SELECT path, 'function:' || target || ':make' || q FROM {x}r r WHERE k = 1 AND p % 7 = 2 AND kind = 'ts' AND {kept}),
{x}edges AS (SELECT 'file:' || path AS source, 'function:' || path || ':' || name AS target, 'contains' AS type, 1.0::DOUBLE AS weight FROM {x}functions UNION SELECT 'file:' || path, 'class:' || path || ':' || name, 'contains', 1.0 FROM {x}classes
UNION SELECT 'file:' || path, 'module:' || source, 'imports', 0.7 FROM {x}modules UNION SELECT 'file:' || path, CASE WHEN kind = 'ts' AND {kept} THEN 'function:' || target || ':make' || q ELSE 'file:' || target END, 'imports', 0.7 FROM {x}r UNION SELECT 'file:' || path, 'class:' || target || ':Part' || q, 'imports', 0.7 FROM {x}r
UNION SELECT 'function:' || r.path || ':' || {made} || r.p, 'function:' || target || ':make' || q, 'calls', 0.9 FROM {x}r r JOIN {x}f f ON f.p = r.p WHERE r.kind = 'ts' AND {kept} UNION SELECT 'function:' || path || ':' || {made} || p, 'function:' || path || ':local' || p, 'calls', 0.9 FROM {x}f f WHERE kind = 'ts' AND p % 13 <> 0
UNION SELECT 'class:' || path || ':Part' || p, 'class:' || target || ':Part' || q, 'inherits', 0.9 FROM {x}r WHERE k = 1 UNION SELECT 'file:' || path, 'function:' || path || ':' || name, 'exports', 0.8 FROM {x}functions WHERE exported UNION SELECT 'file:' || path, 'class:' || path || ':' || name, 'exports', 0.8 FROM {x}classes WHERE exported
UNION SELECT 'class:' || path || ':Part' || p, 'class:' || path || ':Shape' || p, 'implements', 0.9 FROM {x}f WHERE kind = 'ts' UNION SELECT 'class:' || path || ':Part' || p, 'class:' || target || ':Part' || q, 'implements', 0.9 FROM {x}r WHERE k = 2
UNION SELECT 'file:' || target, 'file:' || path, 'tested_by', 0.6 FROM {x}r WHERE test AND NOT target_test UNION SELECT 'file:' || path, 'file:' || target, 'depends_on', 0.5 FROM {x}r UNION SELECT 'file:' || path, 'module:' || source, 'depends_on', 0.5 FROM {x}modules
UNION SELECT 'file:' || path, 'endpoint:' || path || ':' || method || ' ' || route, 'routes', 0.8 FROM {x}routed UNION SELECT 'file:' || path, 'concept:event:' || event, type, 0.6 FROM {x}topics UNION SELECT 'file:' || path, target, 'middleware', 0.6 FROM {x}used UNION SELECT 'file:' || path, 'resource:' || resource, type, 0.5 FROM {x}accesses),
{x}nodes AS (SELECT 'file:' || path AS id, 'file' AS type, string_split(path, '/')[-1] AS name, path AS file_path FROM {x}f UNION SELECT 'function:' || path || ':' || name, 'function', name, path FROM {x}functions UNION SELECT 'class:' || path || ':' || name, 'class', name, path FROM {x}classes
UNION SELECT 'module:' || source, 'module', source, NULL FROM {x}modules UNION SELECT 'endpoint:' || path || ':' || method || ' ' || route, 'endpoint', method || ' ' || route, path FROM {x}routed UNION SELECT 'concept:event:' || event, 'concept', event, NULL FROM {x}topics UNION SELECT 'resource:' || resource, 'resource', resource, NULL FROM {x}accesses)"""
