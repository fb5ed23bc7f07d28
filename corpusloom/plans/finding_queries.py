"""Findings, semantic layer, search and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import caches, extract, findings, patch, search, semantic
from corpusloom.plans.build_queries import FILES, LINES, files
from corpusloom.plans.registry import literal, query
from corpusloom.plans.tables import NODES, nodes, spread, spread_sql, table

SCAN = rf"""WITH {FILES}, {LINES},
dc AS (SELECT path, line, unnest(regexp_extract_all(t, '(\w+)\.(\w+)\(', 1)) AS v, unnest(regexp_extract_all(t, '(\w+)\.(\w+)\(', 2)) AS m FROM l),
ck AS (SELECT path, line, unnest(list_concat(list_concat(regexp_extract_all(t, '(\w+) === (?:null|undefined)', 1), regexp_extract_all(t, '(\w+)\?\.', 1)), regexp_extract_all(t, 'if \((\w+)\)', 1))) AS v FROM l),
vd AS (SELECT path, line, unnest(regexp_extract_all(t, '(?:const|let|var)\s+(\w+)\s*=', 1)) AS v FROM l),
wd AS (SELECT path, unnest(regexp_extract_all(content, '\b\w+\b')) AS v FROM files), us AS (SELECT path, v FROM wd GROUP BY path, v HAVING count(*) <= 1),
td AS (SELECT path, line, unnest(regexp_extract_all(t, '(?i)//\s*(TODO|FIXME|HACK|XXX)', 1)) AS w FROM l),
found AS (
SELECT path, 'bug' AS type, 'Potential null/undefined dereference: ' || v || ' may be null before accessing ' || m || '()' AS description, 0.6::DOUBLE AS confidence, line FROM dc WHERE v NOT IN ('console', 'process', 'Math', 'JSON') AND NOT EXISTS (FROM ck WHERE ck.path = dc.path AND ck.v = dc.v AND ck.line <= dc.line)
UNION ALL SELECT path, 'style', 'Unused variable: ' || v, 0.8, line FROM vd WHERE EXISTS (FROM us WHERE us.path = vd.path AND us.v = vd.v)
UNION ALL SELECT path, 'bug', 'Outstanding ' || w || ' comment indicates incomplete implementation', 0.7, line FROM td
UNION ALL SELECT path, 'style', 'Console logging detected — should use structured logger', 0.5, NULL FROM files WHERE contains(content, 'console.log(') OR contains(content, 'console.error(')
UNION ALL SELECT path, 'style', 'Unsafe "any" type usage detected', 0.6, NULL FROM files WHERE contains(content, ': any') OR contains(content, 'as any')
UNION ALL SELECT path, 'bug', 'Empty catch block swallows errors silently', 0.85, NULL FROM files WHERE regexp_matches(content, 'catch\s*\([^)]*\)\s*\{{\s*(//\s*noop\s*)?\}}'))"""


@query(f"{SCAN} SELECT path, type, description, confidence, coalesce(line, 0) AS line FROM found")
def rule_scan(spark, d):
    return findings.rule_scan(files(spark, d)).withColumn("line", F.coalesce("line", F.lit(0)))


FOUND = "fnd AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'fault' WHEN event_id % 3 = 1 THEN 'insight' ELSE 'pattern' END AS type, least(1.0, value / 100) AS confidence, 'customer:' || user_id AS ref FROM events WHERE event_type = 'error')"


def _found(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    kind = F.when(F.col("event_id") % 3 == 0, "fault").when(F.col("event_id") % 3 == 1, "insight").otherwise("pattern")
    return e.select(F.col("event_id").cast("string").alias("id"), kind.alias("type"), F.concat(F.lit("error of user "), "user_id").alias("description"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"), F.array(F.concat(F.lit("customer:"), "user_id")).alias("node_ids"))


@query(f"WITH {NODES}, {FOUND}, k AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'class:none:' || ref WHEN event_id % 4 = 1 THEN ref ELSE 'file:' || ref END AS r FROM fnd WHERE type <> 'pattern') SELECT CASE WHEN r LIKE 'customer:%' THEN 'file:' || r ELSE r END AS source, 'fault:' || event_id AS target, 'relates_to_fault' AS type, round(confidence, 6) AS weight FROM k WHERE event_id % 4 > 0 AND ref IN (SELECT id FROM nodes)")
def findings_to_missing_files(spark, d):
    """References of three kinds: one that names nothing, a bare path and a file's id."""
    at = F.col("id").cast("long") % 4
    ref = F.get("node_ids", F.lit(0))
    found = _found(spark, d).withColumn("node_ids", F.array(F.when(at == 0, F.concat(F.lit("class:none:"), ref)).when(at == 1, ref).otherwise(F.concat(F.lit("file:"), ref))))
    named = nodes(spark, d).select(F.concat(F.lit("file:"), "id").alias("id"))
    return findings.faults(found, named)[1].select("source", "target", "type", F.round("weight", 6).alias("weight"))


@query(f"WITH {NODES}, {FOUND} SELECT 'file:' || ref AS source, 'fault:' || event_id AS target, 'relates_to_fault' AS type, round(confidence, 6) AS weight FROM fnd WHERE type <> 'pattern' AND ref IN (SELECT id FROM nodes)")
def findings_to_faults(spark, d):
    named = nodes(spark, d).select(F.concat(F.lit("file:"), "id").alias("id"))
    return findings.faults(_found(spark, d), named)[1].select("source", "target", "type", F.round("weight", 6).alias("weight"))


@query(f"WITH {FOUND} SELECT 'fault:' || event_id AS id, CASE type WHEN 'fault' THEN 'high' ELSE 'medium' END AS severity FROM fnd WHERE type <> 'pattern'")
def fault_nodes(spark, d):
    return findings.faults(_found(spark, d), nodes(spark, d))[0].select("id", "severity")


CHANGES = [("p1", 0, "src/a.ts", "Add check", 0.8), ("p1", 1, "package.json", "Bump", 0.6), ("p2", 0, "conf/x.yaml", "Set flag", 0.9), ("p2", 1, "src/b.ts", "Extract helper", 0.4)]
PLAN_FINDINGS = [("p1", "f1", 0.7), ("p1", "f2", 0.9), ("p2", "f3", 0.5)]


_C = spread_sql("c0", "pl, n, path, dsc, conf", CHANGES)
_F = spread_sql("f0", "pl, id, conf", PLAN_FINDINGS)
PLAN = f"{_C}, {_F}, c AS (SELECT *, pl || '-' || g AS plan, g || '/' || path AS file FROM c0), f AS (SELECT *, pl || '-' || g AS plan, id || '-' || p AS finding FROM f0)"


def _plan(spark, d):
    c = spread(spark, d, CHANGES, "plan_id string, idx int, file_path string, description string, confidence double")
    f = spread(spark, d, PLAN_FINDINGS, "plan_id string, id string, confidence double")
    plan = F.concat_ws("-", "plan_id", "g")
    c = c.select(plan.alias("plan_id"), "idx", F.concat_ws("/", F.col("g").cast("string"), "file_path").alias("file_path"), "description", "confidence")
    return c, f.select(plan.alias("plan_id"), F.concat_ws("-", "id", F.col("p").cast("string")).alias("id"), "confidence")


@query(f"WITH {PLAN} SELECT 'fix:' || plan || ':' || n AS source, 'file:' || file AS target, 'fixes' AS type, conf::DOUBLE AS weight FROM c WHERE path = 'src/a.ts' UNION ALL SELECT 'fix:' || c.plan || ':' || n, 'fault:' || finding, 'mitigates', least(c.conf, f.conf)::DOUBLE FROM c JOIN f ON c.plan = f.plan")
def plan_to_fixes(spark, d):
    c, f = _plan(spark, d)
    return findings.fixes(c, f, c.where(F.col("file_path").endswith("src/a.ts")).select(F.concat(F.lit("file:"), "file_path").alias("id")))[1]


@query(f"WITH {PLAN} SELECT 'fix:' || plan || ':' || n AS id, CASE path WHEN 'package.json' THEN 'dependency' WHEN 'conf/x.yaml' THEN 'config' WHEN 'src/b.ts' THEN 'refactor' ELSE 'code' END AS fix_type FROM c")
def fix_types(spark, d):
    c, f = _plan(spark, d)
    return findings.fixes(c, f, c.select(F.lit("").alias("id")).limit(0))[0].select("id", "fix_type")


PATTERNS = [("t1", "fault", "null", 3), ("t1", "fix", "null-safety", 9), ("t2", "fault", "unused", 1)]
SOURCES = [("t1", "fault:f1"), ("t1", "fault:f2"), ("t2", "fix:p:0")]


@query(f"WITH {spread_sql('p0', 't, kind, id, n', PATTERNS)}, {spread_sql('s0', 't, node', SOURCES)} SELECT 'pattern:' || kind || ':' || id || p0.g AS source, node || p0.g AS target, 'learned_from' AS type, least(1.0, 0.5 + 0.1 * n)::DOUBLE AS weight FROM p0 JOIN s0 ON p0.t = s0.t AND p0.g = s0.g")
def patterns_learned_from(spark, d):
    task, g = F.concat_ws("-", "task_id", "g").alias("task_id"), F.col("g").cast("string")
    p = spread(spark, d, PATTERNS, "task_id string, kind string, id string, frequency long").select(task, "kind", F.concat("id", g).alias("id"), "frequency")
    return findings.learned_from(p, spread(spark, d, SOURCES, "task_id string, node string").select(task, F.concat("node", g).alias("node")))


DESCRIBED = [(1, "fault", "Potential null access in src/a.ts at line 4", "src/a.ts"), (2, "style", "Unused variable x", "src/b.js"), (3, "fault", "null again in b.py", "b.py"), (4, "insight", "null ignored", "c.ts"), (5, "fault", "Weird  thing happened  here today", "z.rb"), (6, "style", "Unused import", "q.py")]


@query(f"""WITH {spread_sql('f', 'k, type, dsc, ref', DESCRIBED)}, n AS (SELECT p AS s, ref, trim(regexp_replace(regexp_replace(regexp_replace(dsc, ' in [\\w./-]+\\.\\w+', '', 'g'), ' at line \\d+', '', 'g'), '\\s+', ' ', 'g')) AS t FROM f WHERE type IN ('fault', 'style')),
k AS (SELECT *, CASE WHEN contains(lower(t), 'null') THEN 'null' WHEN contains(lower(t), 'unused') THEN 'unused' ELSE array_to_string(list_slice(regexp_split_to_array(lower(t), '\\s+'), 1, 3), '-') END AS key, regexp_extract(ref, '(\\.[^./]+)$', 1) AS x FROM n)
SELECT key AS id, arg_min(t, s) AS pattern, arg_min(CASE WHEN x IN ('.ts', '.tsx') THEN 'typescript' WHEN x IN ('.js', '.jsx') THEN 'javascript' WHEN x = '.py' THEN 'python' ELSE 'unknown' END, s) AS language, count(*) AS frequency FROM k GROUP BY key""")
def fault_patterns(spark, d):
    return findings.fault_patterns(spread(spark, d, DESCRIBED, "k int, type string, description string, ref string").withColumnRenamed("p", "seq"))


FIXED = [("Use optional chaining here",), ("switch to logger",), ("wrap in try/catch",), ("remove dead code",), ("something else",), ("a?.b",)]


@query(f"WITH {spread_sql('f', 'd', FIXED)} SELECT p, d AS description, CASE WHEN regexp_matches(lower(d), 'optional chaining|\\?\\.|null') THEN 'null safety' WHEN regexp_matches(lower(d), 'logger|console\\.log') THEN 'structured logger' WHEN regexp_matches(lower(d), 'catch|error handling') THEN 'try/catch' WHEN regexp_matches(lower(d), 'unused|dead code') THEN 'remove unused' ELSE d END AS label FROM f")
def fix_patterns(spark, d):
    f = spread(spark, d, FIXED, "description string")
    return f.select("p", "description", T.fix_label(f.description).alias("label"))


@query("SELECT event_type AS id, count(*)::BIGINT + 2 AS frequency FROM events GROUP BY event_type UNION ALL SELECT 'old', 5")
def pattern_upsert(spark, d):
    new = table(spark, d, "events").groupBy(F.col("event_type").alias("id")).agg(F.count("*").alias("frequency"))
    old = new.select("id", F.lit(2).cast("long").alias("frequency")).union(spark.createDataFrame([("old", 5)], "id string, frequency long"))
    return caches.upsert_counts(old, new, "id", "frequency")


@query("WITH r AS (SELECT role AS category, length(text) % 20 AS rule, conv_id * 1000 + turn AS seq, 0.3 + (turn % 5) / 10.0 AS confidence FROM conversations) SELECT category, rule::VARCHAR AS rule, round(least(1.0, arg_min(confidence, seq) + 0.1 * (count(*) - 1)), 6)::DOUBLE AS confidence FROM r GROUP BY category, rule")
def convention_upsert(spark, d):
    c = table(spark, d, "conversations")
    rows = c.select(F.col("role").alias("category"), (F.length("text") % 20).cast("string").alias("rule"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), (0.3 + (F.col("turn") % 5) / 10).alias("confidence"))
    return caches.upsert_conventions(rows).select("category", "rule", F.round("confidence", 6).alias("confidence"))


NAMES = [(1, "function", "doThing"), (2, "function", "makeOther"), (3, "function", "readAll"), (4, "function", "plain"), (5, "function", "writeAll"), (6, "class", "Alpha"), (7, "class", "beta"), (8, "class", "Gamma")]


@query(f"WITH {spread_sql('s', 'k, kind, name', NAMES)}, f AS (SELECT *, CASE kind WHEN 'class' THEN regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') ELSE regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') AND regexp_matches(name, '[A-Z]') END AS ok FROM s), r AS (SELECT kind, avg(ok::INT) AS a FROM f GROUP BY kind HAVING avg(ok::INT) > 0.7) SELECT 'naming' AS category, CASE kind WHEN 'class' THEN 'Classes use PascalCase' ELSE 'Functions use camelCase' END AS rule, (SELECT string_agg(name, ',' ORDER BY p) FROM (SELECT * FROM f WHERE f.kind = r.kind AND ok ORDER BY p LIMIT 3)) AS examples, round(a, 6) AS confidence FROM r")
def naming_conventions(spark, d):
    return findings.naming(spread(spark, d, NAMES, "k int, kind string, name string").withColumnRenamed("p", "seq"))


@query(f"WITH {FILES} SELECT 'testing' AS category, 'Test files use .test. suffix' AS rule, least(1.0, round(0.2 * count(*), 6))::DOUBLE AS confidence FROM files WHERE contains(path, '.test.') OR contains(path, '.spec.') HAVING count(*) > 0")
def testing_conventions(spark, d):
    f = files(spark, d).select(F.xxhash64("path").alias("seq"), "path")
    return findings.testing(f)


@query("SELECT 'architecture' AS category, 'Modules use barrel exports (index.ts)' AS rule, 0.7::DOUBLE AS confidence FROM (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)) WHERE n > 2")
def architecture_conventions(spark, d):
    """Every brand a folder whose index file exports its parts."""
    return findings.architecture(table(spark, d, "part").select(F.concat("p_brand", F.lit("/index.ts")).alias("path"), F.col("p_name").alias("name")))


@query("WITH c AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rule) AS r FROM (SELECT DISTINCT role AS category, length(text) % 7 AS rule FROM conversations)) SELECT category, count(*) AS rules FROM c WHERE category = 'user' GROUP BY category")
def conventions_by_category(spark, d):
    c = table(spark, d, "conversations").select(F.col("role").alias("category"), (F.length("text") % 7).alias("rule")).distinct()
    return c.where("category = 'user'").groupBy("category").agg(F.count("*").alias("rules"))


@query("WITH f AS (SELECT user_id AS task, event_id AS seq, CASE WHEN event_type = 'error' AND value > 60 THEN 'security' WHEN event_type = 'error' THEN 'bug' ELSE 'style' END AS type, event_type AS dsc FROM events) SELECT task, CASE WHEN bool_or(type = 'security') THEN 'critical' WHEN bool_or(type = 'bug') THEN 'high' ELSE 'medium' END AS severity, round(least(0.3 + 0.15 * count(*), 0.9), 6)::DOUBLE AS confidence, string_agg(dsc, '; ' ORDER BY seq) AS root_cause FROM f GROUP BY task")
def severity_rollup(spark, d):
    e = table(spark, d, "events")
    kind = F.when((F.col("event_type") == "error") & (F.col("value") > 60), "security").when(F.col("event_type") == "error", "bug").otherwise("style")
    return findings.root_cause(e.select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("event_type").alias("description")))


CODE = [("t", "a.ts", "x.go(); console.log(1)"), ("t", "b.ts", "const q = 1"), ("u", "a.ts", "try { } catch (e) { }")]
SAID = [("t", "Potential null access"), ("t", "console.log used"), ("u", "Empty catch block"), ("u", "undefined maybe")]


@query(rf"WITH {spread_sql('c0', 't, path, code', CODE)}, {spread_sql('f0', 't, d', SAID)}, c AS (SELECT t || '-' || p // 12 AS t, p || path AS path, code FROM c0), f AS (SELECT t || '-' || p // 12 AS t, d FROM f0), m AS (SELECT DISTINCT c.t AS task, path, code, 'Add null-safety checks' AS description, regexp_replace(code, '(\w+)\.(\w+)\(', '\1?.\2(', 'g') AS modified FROM c JOIN f USING (t) WHERE regexp_matches(lower(d), 'null|undefined') UNION SELECT DISTINCT c.t, path, code, 'Replace console logging with structured logger', regexp_replace(code, 'console\.(log|error)\(', 'logger.info(', 'g') FROM c JOIN f USING (t) WHERE contains(lower(d), 'console.log') UNION SELECT DISTINCT c.t, path, code, 'Add error handling to catch block', regexp_replace(code, 'catch\s*\(([^)]*)\)\s*\{{\s*\}}', 'catch (\1) {{ /* TODO: handle error */ }}', 'g') FROM c JOIN f USING (t) WHERE contains(lower(d), 'empty catch')), k AS (SELECT * FROM m WHERE modified <> code) SELECT task, path, description, modified FROM k UNION ALL SELECT t, path, 'Review and address: it', NULL FROM c WHERE NOT EXISTS (FROM k WHERE k.task = c.t AND k.path = c.path)")
def solution_fallback(spark, d):
    task = F.concat_ws("-", "task", F.floor(F.col("p") / 12).cast("string")).alias("task")
    said = spread(spark, d, SAID, "task string, description string").select(task, "description")
    return findings.solutions(said, spread(spark, d, CODE, "task string, path string, code string").select(task, F.concat(F.col("p").cast("string"), "path").alias("path"), "code"), "it")


@query("SELECT event_type, string_agg(event_id::VARCHAR, '; ' ORDER BY event_id)[:200] AS ids, round(avg(value), 6) AS avg_confidence FROM events WHERE value < 20 GROUP BY event_type")
def low_confidence_query(spark, d):
    e = table(spark, d, "events").where("value < 20")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), "; ")
    return e.groupBy("event_type").agg(F.substring(text, 1, 200).alias("ids"), F.round(F.avg("value"), 6).alias("avg_confidence"))


@query("SELECT event_type AS id, count(*) AS frequency FROM events GROUP BY event_type ORDER BY frequency DESC, id LIMIT 3")
def top_patterns(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("id")).agg(F.count("*").alias("frequency")).orderBy(F.col("frequency").desc(), "id").limit(3)


TARGETS = [("n1", "src/a.ts"), ("n2", None), ("n3", "src/c.ts")]


@query(f"WITH {spread_sql('n', 'id, path', TARGETS)} SELECT id || p AS id FROM n WHERE path IS NULL OR path = 'src/a.ts'")
def target_filter(spark, d):
    n = spread(spark, d, TARGETS, "id string, path string").withColumn("id", F.concat("id", F.col("p").cast("string")))
    wanted = ["src/a.ts"]
    return n.where(F.lit(not wanted) | F.col("path").isNull() | F.col("path").isin(*wanted)).select("id")


# ---- semantic layer

UNITS = [("f1", "getUserApi"), ("f2", "OrderService"), ("f3", "runQuery"), ("f4", "renderView"), ("f5", "stringHelper"), ("f6", "xyz"), ("f7", "logError"), ("f8", "authLogin")]


def _units(spark, d):
    return spread(spark, d, UNITS, "k string, name string").select(F.concat_ws("-", "k", F.col("p").cast("string")).alias("id"), "name")


LAYER = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{'|'.join(ws)}') THEN '{label}'" for label, ws, _ in T.LAYERS) + " ELSE 'unknown' END"


@query(f"WITH {spread_sql('u0', 'k, name', UNITS)}, u AS (SELECT k || '-' || p AS id, name FROM u0), l AS (SELECT id, {LAYER} AS layer FROM u) SELECT id, layer, CASE layer WHEN 'unknown' THEN 0.5 WHEN 'utility' THEN 0.6 ELSE 0.7 END::DOUBLE AS confidence FROM l")
def architecture_layer(spark, d):
    return semantic.layers(_units(spark, d))


@query(f"WITH {spread_sql('u0', 'k, name', UNITS)}, u AS (SELECT k || '-' || p AS id, name FROM u0) SELECT {LAYER} AS layer, count(*) AS members FROM u GROUP BY 1")
def layer_members(spark, d):
    return semantic.layers(_units(spark, d)).groupBy("layer").agg(F.count("*").alias("members"))


@query(f"WITH {spread_sql('u0', 'k, name', UNITS)}, u AS (SELECT k || '-' || p AS id, name FROM u0) SELECT id, CASE WHEN t = '' THEN 'general' ELSE t END AS tags FROM (SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(name), '{'|'.join(ws)}') THEN '{tag}' END" for tag, ws in T.TAGS) + ") AS t FROM u)")
def node_tags(spark, d):
    u = _units(spark, d)
    return u.select("id", F.array_join(T.tags(u.name), ",").alias("tags"))


FUNCS = [("a.ts", n) for n in ("validateInput", "parseRow", "save", "load")] + [("b.ts", n) for n in ("one", "formatTwo", "three")] + [("c.ts", "alone")]
LINKS = [("a.ts", "parseRow", "save"), ("a.ts", "validateInput", "parseRow"), ("a.ts", "save", "ghost"), ("a.ts", "save", "save")]
CAND = f"{spread_sql('f0', 'path, n', FUNCS)}, {spread_sql('c0', 'path, a, b', LINKS)}, f AS (SELECT p // 8 || path AS path, n FROM f0), c AS (SELECT p // 8 || path AS path, a, b FROM c0), k AS (SELECT DISTINCT path, a, b FROM (SELECT path, a, b FROM c UNION ALL SELECT path, b, a FROM c) x WHERE a <> b AND EXISTS (FROM f WHERE f.path = x.path AND f.n = a) AND EXISTS (FROM f WHERE f.path = x.path AND f.n = b)), cand AS (SELECT * FROM k UNION ALL SELECT x.path, x.n, y.n FROM f x JOIN f y ON x.path = y.path AND x.n <> y.n WHERE x.path NOT IN (SELECT path FROM k))"


def _candidates(spark, d):
    path = F.concat(F.floor(F.col("p") / 8).cast("string"), "path").alias("path")
    return semantic.pairs(spread(spark, d, FUNCS, "path string, name string").select(path, "name"), spread(spark, d, LINKS, "path string, from string, to string").select(path, "from", "to"))


@query(f"WITH {CAND} SELECT path, a, b FROM cand")
def semantic_pairs(spark, d):
    return _candidates(spark, d)


@query(f"WITH {CAND} SELECT 'function:' || path || ':' || a AS source, 'function:' || path || ':' || b AS target, CASE WHEN contains(lower(a), 'validate') THEN 'validates' ELSE 'transforms' END AS type, 0.6::DOUBLE AS weight FROM cand WHERE regexp_matches(lower(a), 'validate|parse|format|transform|convert')")
def semantic_edges(spark, d):
    return semantic.semantic_edges(_candidates(spark, d))


@query(None)
def pair_batches(spark, d):
    p = table(spark, d, "lineitem").select(F.concat(F.lit("supplier-"), "l_suppkey").alias("path"), F.col("l_partkey").cast("string").alias("a"), F.col("l_suppkey").cast("string").alias("b")).distinct()
    return semantic.batches(p)


@query(f"WITH {NODES} SELECT id, upper(left(type, 1)) || substring(type, 2) || ' ' || name || coalesce(' in ' || file_path, '') AS summary FROM nodes WHERE type IN ('file', 'service')")
def node_summary(spark, d):
    n = nodes(spark, d).where("type in ('file', 'service')")
    return n.select("id", semantic.summary(n.type, n.name, n.file_path).alias("summary"))


@query("SELECT event_id, 'finding-' || user_id || '-llm-' || (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS id FROM events")
def finding_ordinals(spark, d):
    return findings.numbered(table(spark, d, "events"), "user_id", "event_id").select("event_id", "id")


# ---- search

HOST = "regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1)"


@query(f"SELECT page_id, CASE WHEN h = '' THEN 'unknown' WHEN contains(h, 'stackoverflow') THEN 'stackoverflow' WHEN contains(h, 'github') THEN 'github' WHEN contains(h, 'developer.mozilla') THEN 'mdn' WHEN contains(h, 'react.dev') THEN 'react-docs' WHEN contains(h, 'medium') THEN 'medium' ELSE regexp_replace(h, '^www\\.', '') END AS source, 0.6::DOUBLE AS score FROM (SELECT page_id, {HOST} AS h FROM pages)")
def url_source_score(spark, d):
    p = table(spark, d, "pages").select("page_id", search.source(F.col("url")).alias("source"))
    return p.select("page_id", "source", search.credibility(p.source).alias("score"))


def _block(title, url, snippet, shown):
    return f'<div class="result results_links"><h2 class="result__title"><a rel="x" class="result__a" href="{url}">{title}</a></h2><a class="result__url" href="{shown}">u</a><div class="result__snippet">{snippet}</div></div>'


BLOCKS = [("Fix <b>map</b> errors", "https://stackoverflow.com/q/", "Use &quot;?.&quot; on map", "map"), ("Unrelated", "https://example.org/", "nothing", "zzz"), ("Map guide", "/l/?uddg=https%3A%2F%2Fmedium.com%2Fp&amp;rut=", "", "map"), ("On github", "https://www.github.com/a", "a repo", "zzz")]
PARSED = [("Fix map errors", "https://stackoverflow.com/q/", 'Use "?." on map', "stackoverflow", 0.95), (None, None, None, None, None), ("Map guide", "https://medium.com/p", "Map guide", "medium", 0.70), ("On github", "https://www.github.com/a", "a repo", "github", 0.88)]


@query(f"WITH {spread_sql('r', 'title, url, snippet, source, score', PARSED)} SELECT 'map undefined ' || (p // 16) AS query, (p % 16)::INTEGER AS position, title, CASE WHEN p % 8 = 0 THEN 'https://shown.example/' || p WHEN p % 4 = 2 THEN url ELSE url || p END AS url, snippet, source, score::DOUBLE AS score FROM r WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p // 16 ORDER BY p) <= 5")
def parse_result_page(spark, d):
    """A page of up to 16 results for every 16 parts."""
    b = spread(spark, d, BLOCKS, "title string, url string, snippet string, word string").select("p", F.floor(F.col("p") / 16).alias("page"), F.lit(_block("%T", "%U", "%S", "%D")).alias("form"), "title", F.concat("url", F.col("p").cast("string")).alias("url"), "snippet", F.when(F.col("p") % 8 == 0, F.concat(F.lit("https://shown.example/"), F.col("p").cast("string"))).otherwise("").alias("shown"))
    block = F.replace(F.replace(F.replace(F.replace("form", F.lit("%T"), F.col("title")), F.lit("%U"), F.col("url")), F.lit("%S"), F.col("snippet")), F.lit("%D"), F.col("shown"))
    pages = b.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", block.alias("b")))), lambda x: x["b"]), "").alias("body"))
    pages = pages.select(F.concat(F.lit("map undefined "), F.col("page").cast("string")).alias("query"), F.concat(F.lit("<html>"), "body", F.lit("</html>")).alias("html"))
    return search.parse_page(pages)


SCORED = [("q1", 0, "s0", 0.3), ("q1", 1, "s1", 0.6), ("q1", 2, "s2", 0.95), ("q1", 3, "s3", 0.6), ("q2", 0, "s4", 0.5), ("q3", 0, "s5", 0.9)]


def _scored(spark, d):
    r = spread(spark, d, SCORED, "q string, n int, snippet string, score double")
    return r.select(F.concat_ws("-", "q", (F.col("g") % 40).cast("string")).alias("query"), F.col("p").alias("position"), F.concat("snippet", F.col("p").cast("string")).alias("snippet"), "score")


@query(f"WITH {spread_sql('r0', 'q, n, snippet, score', SCORED)}, r AS (SELECT q || '-' || g % 40 AS query, p AS position, snippet || p AS snippet, score FROM r0) SELECT query, position, snippet FROM r WHERE score > 0.5 QUALIFY row_number() OVER (PARTITION BY query ORDER BY position) <= 2")
def supporting_results(spark, d):
    return search.supporting(_scored(spark, d)).select("query", "position", "snippet")


@query(f"WITH {spread_sql('r0', 'q, n, snippet, score', SCORED)}, r AS (SELECT q || '-' || g % 40 AS query, p AS position, snippet || p AS snippet, score FROM r0) SELECT query, snippet, row_number() OVER (PARTITION BY query ORDER BY score DESC, position)::INTEGER AS rank FROM r QUALIFY rank <= 5")
def results_by_credibility(spark, d):
    return search.by_credibility(_scored(spark, d)).select("query", "snippet", "rank")


OFFERED = [("q1", 2, "b1"), ("q1", 1, "a1"), ("q1", 1, "a2"), ("q2", 3, "c1"), ("q2", 2, "b2")]


def _offered(spark, d):
    r = spread(spark, d, OFFERED, "q string, priority int, t string")
    return r.select(F.concat_ws("-", "q", (F.col("g") % 40).cast("string")).alias("query"), "priority", F.concat("t", F.col("p").cast("string")).alias("title"))


@query(f"WITH {spread_sql('r0', 'q, priority, t', OFFERED)}, r AS (SELECT q || '-' || g % 40 AS query, priority, t || p AS title FROM r0) SELECT query, priority, title FROM r QUALIFY priority = min(priority) OVER (PARTITION BY query)")
def provider_fallback(spark, d):
    return search.first_provider(_offered(spark, d)).select("query", "priority", "title")


ASKED = [("map of undefined",), ("memory leak",), ("async cleanup",), ("nothing known",), (" ",)]


def _simulated_sql() -> str:
    rows = " UNION ALL ".join("SELECT query, " + ", ".join([literal(t) + " AS title", literal(u) + " AS url", literal(s) + " AS snippet", literal(c) + " AS source", f"{x}::DOUBLE AS score"]) + " FROM q WHERE " + " AND ".join("regexp_matches(lower(query), '" + "|".join(g) + "')" for g in groups) for groups, t, u, s, c, x in search.SIMULATED)
    t, u, s, c, x = search.GENERIC
    return f"WITH {spread_sql('q0', 'q', ASKED)}, q AS (SELECT CASE WHEN trim(q) = '' THEN q ELSE q || ' ' || p END AS query FROM q0), r AS ({rows}), a AS (SELECT * FROM r UNION ALL SELECT query, {literal(t)} || query, {literal(u)}, {literal(s)} || query || '\".', {literal(c)}, {x} FROM q WHERE trim(query) <> '' AND query NOT IN (SELECT query FROM r)) SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC)::INTEGER AS rank FROM a"


@query(_simulated_sql())
def simulate_results(spark, d):
    return search.simulate(spread(spark, d, ASKED, "q string").select(F.when(F.trim("q") == "", F.col("q")).otherwise(F.concat_ws(" ", "q", F.col("p").cast("string"))).alias("query")))


PARAMS = [(1, "TypeError x", "ts", None, None), (2, None, None, "react", "hooks"), (3, None, None, None, None), (4, None, "py", None, "p")]


FILLED = [("error_message", "TypeError x ts"), ("error_message", "react"), (None, None), ("error_message", "py")]


@query(f"WITH {spread_sql('r', 'template, query', FILLED)} SELECT p AS id, template, query FROM r")
def fill_templates(spark, d):
    p = spread(spark, d, PARAMS, "k int, errorMessage string, language string, framework string, pattern string").withColumnRenamed("p", "id").drop("k", "g")
    return search.fill(p, ("errorMessage", "language", "framework", "pattern"))


@query("WITH g AS (SELECT user_id, count(*) AS n, avg(least(1.0, value / 100)) AS c FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT user_id, n > 0 AND (c < 0.5 OR (n <= 1 AND c < 0.7)) AS search FROM g")
def search_trigger(spark, d):
    g = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.avg(F.least(F.lit(1.0), F.col("value") / 100)).alias("c"))
    return g.select("user_id", search.needs_search(g.n, g.c).alias("search"))


@query("SELECT item_id FROM benchmark WHERE contains(lower(text), 'the') OR contains(lower(text), 'stackoverflow') OR contains(lower(text), 'github')")
def relevance_filter(spark, d):
    b = table(spark, d, "benchmark")
    return b.where(search.relevant(F.lit("of the"), b.text, F.lit(""))).select("item_id")


REMOTE_PARTS = [("git@host.example:team/tool", "host.example", "team", "tool"), ("https://user@host.example/group/sub/tool", "host.example", "group/sub", "tool"), ("ssh://git@h.io/o/r", "h.io", "o", "r"), ("nonsense", "", "", "")]


@query(f"WITH {spread_sql('r', 'u, host, owner, repo', REMOTE_PARTS)} SELECT u || p || CASE WHEN p % 2 = 0 THEN '.git' ELSE '' END AS url, host, owner, CASE WHEN repo = '' THEN '' ELSE repo || p END AS repo FROM r")
def remote_url_parts(spark, d):
    r = spread(spark, d, [(u,) for u, *_ in REMOTE_PARTS], "u string")
    r = r.select(F.concat("u", F.col("p").cast("string"), F.when(F.col("p") % 2 == 0, ".git").otherwise("")).alias("url"))
    return r.select("url", *search.remote_parts(r.url))


@query("SELECT page_id, md5(trim(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&quot;', chr(34)), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)), '&#39;', chr(39)), '&nbsp;', ' '))) AS text_md5 FROM pages")
def strip_pages(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.md5(T.strip_tags(p.html)).alias("text_md5"))


# ---- patches

EDITS = [("p1", "a\nb\nc", "a\nx\nc\nd"), ("p2", "same", "same"), ("p3", "one\ntwo", "one")]


@query(f"WITH {spread_sql('e0', 'k, old, new', EDITS)}, e AS (SELECT k || '-' || p AS id, old, new || chr(10) || p AS new FROM e0), o AS (SELECT id, generate_subscripts(x, 1) AS line, unnest(x) AS t FROM (SELECT id, string_split(old, chr(10)) AS x FROM e)), n AS (SELECT id, generate_subscripts(x, 1) AS line, unnest(x) AS t FROM (SELECT id, string_split(new, chr(10)) AS x FROM e)), b AS (SELECT coalesce(o.id, n.id) AS id, coalesce(o.line, n.line)::INTEGER AS line, o.t AS ot, n.t AS nt FROM o FULL JOIN n ON o.id = n.id AND o.line = n.line) SELECT id, line, '-' AS op, ot AS text FROM b WHERE ot IS DISTINCT FROM nt AND ot IS NOT NULL UNION ALL SELECT id, line, '+', nt FROM b WHERE ot IS DISTINCT FROM nt AND nt IS NOT NULL")
def line_diff(spark, d):
    return patch.line_diff(spread(spark, d, EDITS, "k string, old string, new string").select(F.concat_ws("-", "k", F.col("p").cast("string")).alias("id"), "old", F.concat("new", F.lit("\n"), F.col("p").cast("string")).alias("new")))




def _patches(spark, d):
    return spread(spark, d, FILEPATCHES, "k string, old string, new string, cur string").select(F.concat("k", F.col("p").cast("string")).alias("id"), "old", "new", "cur")


FILEPATCHES = [("a", None, "new", None), ("b", "old", None, "old"), ("c", "old", "new", "old"), ("d", "mid", "MID", "x mid y mid"), ("e", "gone", "n", "other")]


@query(f"WITH {spread_sql('f', 'k, old, new, cur', FILEPATCHES)} SELECT k || p AS id, CASE WHEN old IS NULL AND new IS NOT NULL THEN 'added' WHEN new IS NULL THEN 'deleted' ELSE 'modified' END AS kind FROM f")
def patch_kind(spark, d):
    p = _patches(spark, d)
    return p.select("id", patch.change_type(p.old, p.new).alias("kind"))


APPLIED = [("a", "created", "new"), ("b", "deleted", None), ("c", "exact", "new"), ("d", "replaced", "x MID y mid"), ("e", "conflict", "other")]


@query(f"WITH {spread_sql('r', 'k, status, result', APPLIED)} SELECT k || p AS id, status, result FROM r")
def apply_patch_status(spark, d):
    p = _patches(spark, d)
    return p.select("id", patch.apply(p.cur, p.old, p.new).alias("x")).select("id", "x.status", "x.result")


@query(f"WITH {spread_sql('f', 'k, old, new, cur', FILEPATCHES)} SELECT count(*) FILTER (WHERE old IS NULL) AS added, count(*) FILTER (WHERE old IS NOT NULL AND new IS NOT NULL) AS modified, count(*) FILTER (WHERE new IS NULL) AS deleted FROM f")
def patch_summary(spark, d):
    return patch.summary(_patches(spark, d))


@query("WITH c AS (SELECT CASE WHEN o_custkey % 50 = 0 THEN 'main' ELSE 'b' || o_custkey END AS branch, o_orderkey AS path, 60 AS lines FROM orders), g AS (SELECT branch, count(DISTINCT path) AS f, sum(lines) AS l FROM c GROUP BY branch) SELECT branch, 'too many files' AS violation FROM g WHERE f > 20 UNION ALL SELECT branch, 'diff too large' FROM g WHERE l > 500 UNION ALL SELECT branch, 'protected branch' FROM g WHERE branch IN ('main', 'master', 'production', 'release')")
def change_limits(spark, d):
    o = table(spark, d, "orders")
    branch = F.when(F.col("o_custkey") % 50 == 0, "main").otherwise(F.concat(F.lit("b"), "o_custkey"))
    return patch.limits(o.select(branch.alias("branch"), F.col("o_orderkey").alias("path"), F.lit(60).alias("lines")))


LONG = "x\n" * 40
SUMMARY = "// Structural summary of big.ts\n\nimport { a, b } from './m';\nimport d from 'e';\nimport './side';\n\nexport function f(p, q);\n\nclass K {\n}\n\nexport { f };"


SUMMARISED = [("big.ts", SUMMARY, float(round((1 - len(SUMMARY) / len(LONG)) * 100))), ("small.ts", "tiny", 0.0)]


@query(f"WITH {spread_sql('r', 'path, summary, savings_pct', SUMMARISED)} SELECT p || '/' || path AS path, replace(summary, ' of big', ' of ' || p || '/big') AS summary, CASE WHEN path = 'big.ts' THEN round((1 - ({len(SUMMARY)} + length(p::VARCHAR) + 1) / {len(LONG)}.0) * 100) ELSE 0 END::DOUBLE AS savings_pct FROM r")
def structural_summary(spark, d):
    kind = "path string, content string, total_lines int, imports array<struct<source string, items array<string>, is_default boolean>>, functions array<struct<name string, params array<string>, is_exported boolean>>, classes array<struct<name string, is_exported boolean>>, exports array<string>"
    rows = [("big.ts", LONG, 41, [("./m", ["a", "b"], False), ("e", ["d"], True), ("./side", [], False)], [("f", ["p", "q"], True)], [("K", False)], ["f"]), ("small.ts", "tiny", 1, [], [], [], [])]
    return patch.structural_summary(spread(spark, d, rows, kind).withColumn("path", F.concat_ws("/", F.col("p").cast("string"), "path")).drop("p", "g"))


BROKEN = [(1, '{"a": [1, 2'), (2, '```json\n{"b": "x"}\n```'), (3, '{"c": "cut'), (4, "not json"), (5, '{"d":'), (6, None)]


FIXES = [('{"a": [1, 2]}',), ('{"b": "x"}',), ('{"c": "cut"}',), (None,), ('{"d":null}',), (None,)]


@query(f"WITH {spread_sql('r', 'fixed', FIXES)} SELECT p AS id, fixed FROM r")
def json_repair(spark, d):
    b = spread(spark, d, [(t,) for _, t in BROKEN], "t string")
    return b.select(F.col("p").alias("id"), F.trim(extract.repaired(b.t)).alias("fixed"))


# ---- caches

@query("SELECT user_id, max(ts) AS last FROM events GROUP BY user_id ORDER BY max((ts, event_id)) DESC LIMIT 50")
def lru_retain(spark, d):
    return caches.lru(table(spark, d, "events"), "user_id", "ts", 50, "event_id")


@query("SELECT d.doc_id, c.h IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0) c ON c.h = sha256(d.text)")
def cache_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    hits, misses = caches.probe(docs, docs.where("doc_id % 2 = 0").select("h").distinct(), "h")
    return hits.select("doc_id", F.lit(True).alias("hit")).union(misses.select("doc_id", F.lit(False)))
