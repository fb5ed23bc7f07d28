"""Fingerprints, embedding texts and inferred patches over literal code."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import fingerprint as P
from corpusloom.plans.build_queries import FILES, files
from corpusloom.plans.registry import query
from corpusloom.plans.tables import spread, spread_sql, table

KEYWORDS = ", ".join(f"'{k}'" for k in P.KEYWORDS)


@query(rf"WITH {FILES}, c AS (SELECT path, list_filter(regexp_extract_all(content, '([A-Za-z_$][\w$]*)\s*\(', 1), lambda w: w NOT IN ({KEYWORDS})) AS c FROM files) SELECT path, len(list_distinct(c))::INTEGER AS n, coalesce(array_to_string(list_sort(list_distinct(c)), ' '), '') AS callees FROM c")
def callees(spark, d):
    f = files(spark, d).select("path", P.callees(F.col("content")).alias("c"))
    return f.select("path", F.size("c").alias("n"), F.array_join(F.array_sort("c"), " ").alias("callees"))


@query(rf"WITH {FILES} SELECT path, sha256(content) AS content_hash, len(string_split(content, chr(10)))::INTEGER AS total_lines, len(list_filter(string_split(content, chr(10)), lambda t: regexp_matches(t, '^(export\s+)?class\s+(\w+)')))::INTEGER AS n_classes, regexp_matches(content, '(^|\n)((export\s+)?(async\s+)?function\s+\w+\s*\(|(export\s+)?const\s+\w+\s*=\s*(async\s*)?\([^)]*\)\s*=>|(export\s+)?const\s+\w+\s*=\s*async\s+function|(export\s+)?class\s|import\s+(\{{|\w+\s+from)|export\s+(default\s+)?(async\s+)?(function|class|const|let|var))') AS has_structure FROM files")
def fingerprint_files(spark, d):
    return P.fingerprints(files(spark, d)).select("path", "content_hash", "total_lines", F.size("classes").alias("n_classes"), "has_structure")


OTHER = [("a.go", 'package x\nimport "fmt"\nfunc (s *S) Run(a int) error {\n}\ntype S struct {\n}\nfunc main() {\n}\n'), ("B.java", "import java.util.List;\npublic class B extends A {\n  public static int go(int x) {\n  }\n  private void stop() {\n  }\n}\n"), ("c.rb", "def x")]
OTHER_ROWS = [("a.go", 2, "import", "fmt", ""), ("a.go", 3, "function", "Run", "a int"), ("a.go", 5, "class", "S", "struct"), ("a.go", 7, "function", "main", ""), ("B.java", 1, "import", "java.util.List", ""), ("B.java", 2, "class", "B", "A"), ("B.java", 3, "function", "go", "int x"), ("B.java", 5, "function", "stop", "")]


PATHS_OF = [(p,) for p, _ in OTHER]
_ROWS = " UNION ALL ".join(f"SELECT '{p}' AS path, {n} AS line, '{k}' AS kind, '{m}' AS name, '{x}' AS detail" for p, n, k, m, x in OTHER_ROWS)


@query(f"WITH {spread_sql('f', 'path', PATHS_OF)}, r AS ({_ROWS}) SELECT f.p || '/' || f.path AS path, line, kind, name, detail FROM f JOIN r ON r.path = f.path")
def other_signatures(spark, d):
    return P.other_signatures(spread(spark, d, OTHER, "path string, content string").select(F.concat_ws("/", F.col("p").cast("string"), "path").alias("path"), "content"))


FNS = [("load", ["path", "mode"], "Data", ["open", "read"]), ("noop", [], None, None), ("one", ["x"], None, [])]


@query(f"WITH {spread_sql('f', 'name, params, ret, calls', FNS)} SELECT p, name, name || '(' || coalesce(array_to_string(params, ', '), '') || ')' || coalesce(' -> ' || ret, '') || CASE WHEN len(calls) > 0 THEN ' calls ' || array_to_string(calls, ' ') ELSE '' END AS text, name || '(' || coalesce(array_to_string(params, ', '), '') || ')' || coalesce(': ' || ret, '') AS signature FROM f")
def function_texts(spark, d):
    f = spread(spark, d, FNS, "name string, params array<string>, ret string, calls array<string>")
    return f.select("p", "name", P.function_text(f.name, f.params, f.ret, f.calls).alias("text"), P.signature(f.name, f.params, f.ret).alias("signature"))


CLASSES = [("Store", "Base", ["Readable", "Closable"], ["get", "put"], ["size"]), ("Bare", None, None, [], [])]


CLASS_TEXTS = [("Store", "Store extends Base implements Readable Closable methods get put props size"), ("Bare", "Bare")]


@query(f"WITH {spread_sql('r', 'name, text', CLASS_TEXTS)} SELECT p, name, text FROM r")
def class_texts(spark, d):
    c = spread(spark, d, CLASSES, "name string, parent string, interfaces array<string>, methods array<string>, properties array<string>")
    return c.select("p", "name", P.class_text(c.name, c.parent, c.interfaces, c.methods, c.properties).alias("text"))


@query(r"SELECT doc_id, substring(array_to_string(list_slice(list_filter(list_transform(list_slice(string_split(text, chr(10)), 1, 20), lambda x: trim(regexp_replace(trim(x), '^(//+|/\*+|\*+/?|#)\s?', ''))), lambda x: x <> ''), 1, 3), ' '), 1, 200) AS lead FROM documents WHERE text <> ''")
def leading_comments(spark, d):
    docs = table(spark, d, "documents").where("text <> ''")
    return docs.select("doc_id", T.leading_comment(docs.text).alias("lead"))


PATCHES = [("p1", "a.get(1); console.log(2)", "may be null"), ("p2", "console.warn(x)", "use logger"), ("p3", "let v: any = y as any", "wrong type"), ("p4", "a.b(1)", "nothing")]
PATCHED = [("p1", "a?.get(1); console.log(2)"), ("p2", "logger.info(x)"), ("p3", "let v: unknown = y as unknown"), ("p4", "a.b(1)")]


@query(f"WITH {spread_sql('r', 'id, code', PATCHED)} SELECT id || p AS id, code FROM r")
def inferred_patches(spark, d):
    p = spread(spark, d, PATCHES, "k string, code string, description string")
    return p.select(F.concat("k", F.col("p").cast("string")).alias("id"), P.infer_patch(p.code, p.description).alias("code"))


RULE = "─" * 60


@query(f"SELECT p_partkey || '.ts' AS path, CASE p_partkey % 3 WHEN 0 THEN 'Added' WHEN 1 THEN 'Deleted' ELSE 'Modified' END || ': ' || p_partkey || '.ts' || chr(10) || '{RULE}' || chr(10) || '+' || p_name || chr(10) || '{RULE}' AS text FROM part")
def rendered_patch(spark, d):
    p = table(spark, d, "part")
    kind = F.when(p.p_partkey % 3 == 0, "added").when(p.p_partkey % 3 == 1, "deleted").otherwise("modified")
    path = F.concat(p.p_partkey.cast("string"), F.lit(".ts"))
    return p.select(path.alias("path"), P.render(path, kind, F.concat(F.lit("+"), "p_name")).alias("text"))
