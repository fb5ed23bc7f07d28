"""Vectors, graph building and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.functions import vector as V
from corpusloom.model import CLUSTER_STOP, IGNORED_DIRS, IGNORED_FILES, SOURCE_EXTENSIONS
from corpusloom.operators import build, extract, layers, outline, similarity
from corpusloom.plans import code_rows as C
from corpusloom.plans.code_files import REPOSITORIES, asset_paths, code_files, line_files, python_files, repositories, schema_files, sql
from corpusloom.plans.registry import literal, query
from corpusloom.plans.tables import table
from corpusloom.shared import store

UNIT = "v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
COS = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"
PAIRS = f"{UNIT}, pairs AS (SELECT a.id AS a, b.id AS b, a.label AS la, b.label AS lb, {COS} AS cosine FROM v a JOIN v b ON a.id < b.id)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


@query(f"WITH {PAIRS} SELECT a, b, round(cosine, 6) AS cosine FROM pairs WHERE cosine >= 0.40")
def cosine_pairs(spark, d):
    return similarity.cosine_pairs(vectors(spark, d), 0.40).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {PAIRS} SELECT a, b, round(cosine, 6) AS cosine FROM pairs WHERE cosine >= 0.30 AND la = lb")
def cosine_pairs_within_type(spark, d):
    return similarity.cosine_pairs(vectors(spark, d), 0.30, within="label").select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {PAIRS}, c AS (SELECT * FROM pairs WHERE cosine >= 0.25), m AS (SELECT a AS n, b AS o, cosine FROM c UNION ALL SELECT b, a, cosine FROM c), t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY n ORDER BY cosine DESC, o) <= 5) SELECT DISTINCT least(n, o) AS source, greatest(n, o) AS target, CASE WHEN cosine >= 0.4 THEN 'similar_to' ELSE 'related' END AS type, round(cosine, 6) AS weight FROM t")
def similarity_bands_topk(spark, d):
    best = similarity.nearest(vectors(spark, d), 0.25, 5)
    return best.select(F.col("a").alias("source"), F.col("b").alias("target"), similarity.band(F.col("cosine"), 0.4, 0.25).alias("type"), F.round("cosine", 6).alias("weight"))


REACH = f"""WITH RECURSIVE {PAIRS}, l AS (SELECT a::VARCHAR AS a, b::VARCHAR AS b FROM pairs WHERE cosine >= 0.40), s AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(n, m) AS (SELECT a, a FROM s UNION SELECT r.n, s.b FROM r JOIN s ON s.a = r.m), c AS (SELECT n AS member, min(m) AS root FROM r GROUP BY n), g AS (SELECT root, substring(sha256(string_agg(member, '|' ORDER BY member)), 1, 8) AS cluster FROM c GROUP BY root), k AS (SELECT g.cluster, c.member FROM c JOIN g USING (root))"""


@query(f"{REACH} SELECT cluster, member FROM k")
def concept_clusters(spark, d):
    return similarity.grouped(similarity.linked(vectors(spark, d), 0.40))


STOP = ", ".join(f"'{w}'" for w in CLUSTER_STOP)


@query(f"{REACH}, w AS (SELECT k.cluster, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,}}'), lambda x: x NOT IN ({STOP})))) AS w FROM k JOIN documents ON doc_id = k.member::BIGINT), n AS (SELECT cluster, w, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 2), b AS (SELECT cluster, w FROM n QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, length(w) DESC, w) = 1) SELECT DISTINCT k.cluster, coalesce(b.w, 'cluster-' || left(k.cluster, 6)) AS name FROM k LEFT JOIN b ON b.cluster = k.cluster")
def cluster_names(spark, d):
    found = store(similarity.grouped(similarity.linked(vectors(spark, d), 0.40)), "concepts")
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("member"), "text")
    return similarity.cluster_names(found.join(texts, "member", "left").select("cluster", "text"))


@query("WITH w AS (SELECT p_brand AS cluster, p_partkey, unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) AS w, generate_subscripts(string_split_regex(lower(p_name), '[^a-z0-9]+'), 1) AS k FROM part), n AS (SELECT cluster, w, count(*) AS n, min(p_partkey * 100 + k) AS f FROM w WHERE length(w) > 2 GROUP BY ALL HAVING count(*) > 1), b AS (SELECT cluster, w FROM n QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) = 1) SELECT c.cluster, b.w AS token FROM (SELECT DISTINCT p_brand AS cluster FROM part) c LEFT JOIN b USING (cluster)")
def common_tokens(spark, d):
    names = table(spark, d, "part").select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("position"), F.col("p_name").alias("name"))
    return similarity.common_tokens(names)


@query(f"WITH {UNIT} SELECT vec_id AS id, round(sqrt(list_dot_product(e, e)), 6) AS norm, 1.0::DOUBLE AS unit FROM v JOIN embeddings ON id = vec_id")
def vector_norms(spark, d):
    v = vectors(spark, d).select("id", F.transform("vector", lambda x: x.cast("double")).alias("v"))
    return v.select("id", F.round(V.norm(v.v), 6).alias("norm"), F.round(V.norm(V.normalise(v.v)), 6).alias("unit"))


TEXTS = "t AS (SELECT item_id AS id, '  ' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) || '  ' AS p FROM benchmark WHERE length(text) > 0), g AS (SELECT id, unnest(list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3))) AS g FROM t)"


@query(f"WITH {TEXTS} SELECT id, count(DISTINCT g) AS trigrams, count(*) AS places, 1.0::DOUBLE AS length FROM g GROUP BY id")
def trigram_embedding(spark, d):
    texts = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    length = V.trigram_buckets(texts).groupBy("id").agg(F.round(F.sqrt(F.sum(F.col("value") * F.col("value"))), 6).alias("length"))
    plain = F.concat(F.lit("  "), F.trim(F.regexp_replace(F.lower("text"), "\\s+", " ")), F.lit("  "))
    grams = F.transform(F.sequence(F.lit(1), F.length(plain) - 2), lambda i: F.substring(plain, i, F.lit(3)))
    return texts.where("length(text) > 0").select("id", F.size(F.array_distinct(grams)).cast("long").alias("trigrams"), F.size(grams).cast("long").alias("places")).join(length, "id")


@query("SELECT p_name AS word, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(p_name) + 1), lambda i: ascii(substring(p_name, i, 1))::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS hash FROM (SELECT DISTINCT p_name FROM part)")
def fnv_hash(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("word")).distinct().select("word", V.fnv1a(F.col("word")).alias("hash"))


@query("SELECT vec_id AS id, vec_id % 3 <> 0 AS hit FROM embeddings")
def embedding_cache_probe(spark, d):
    from corpusloom.operators.caches import probe

    v = vectors(spark, d)
    hits, misses = probe(v, v.where("id % 3 <> 0").select("id", F.col("vector").alias("cached")), "id")
    return hits.select("id", F.lit(True).alias("hit")).union(misses.select("id", F.lit(False)))


# ---- building, over files made of the tables

CODE = f"WITH {sql()}"
FILES = REPOSITORIES
LINES = "l AS (SELECT path, generate_subscripts(x, 1)::INTEGER AS line, unnest(x) AS t FROM (SELECT path, string_split(content, chr(10)) AS x FROM files))"


def files(spark, d):
    return repositories(spark, d)


#: The facts that edges between symbols follow from; exports are asked for by none of them.
SYMBOLS = ("functions", "classes", "imports")


def built(spark, d, files=None):
    """The facts of the files and their scope."""
    facts = store(outline.facts(code_files(spark, d) if files is None else files).select("path", *SYMBOLS), "facts")
    return facts, layers.scope(facts)


def imports_of(spark, d, files=None):
    """The imports of the files, resolved: of their facts only these are made."""
    facts = store(outline.facts(code_files(spark, d) if files is None else files).select("path", "imports"), "imports")
    return layers.resolved(facts, facts)


def of_type(*types):
    return f"{CODE} SELECT source, target, type, weight FROM edges WHERE type IN ({', '.join(map(literal, types))})"


@query(f"{CODE} SELECT path, spec AS source, target AS resolved FROM r UNION ALL SELECT path, source, NULL FROM modules")
def resolve_imports(spark, d):
    return imports_of(spark, d).select("path", "source", "resolved")


@query(of_type("imports"))
def import_edges(spark, d):
    _, s = built(spark, d)
    return build.import_edges(s.items, s.imports, s.symbols)


@query(of_type("calls"))
def call_edges(spark, d):
    facts, s = built(spark, d)
    return build.reference_edges(layers.calls(facts), "function", s.symbols, s.imported, "calls", 0.9)


@query(of_type("inherits"))
def inherit_edges(spark, d):
    facts, s = built(spark, d)
    return build.reference_edges(layers.parents(facts), "class", s.symbols, s.imported, "inherits", 0.9)


@query(of_type("implements"))
def implement_edges(spark, d):
    facts, s = built(spark, d)
    return build.reference_edges(layers.interfaces(facts), "class", s.symbols, s.imported, "implements", 0.9)


@query(of_type("exports"))
def export_edges(spark, d):
    facts = outline.facts(code_files(spark, d))
    return build.export_edges(facts.select("path", F.explode("exports").alias("e")).select("path", "e.name", "e.kind"))


@query(of_type("contains"))
def contains_edges(spark, d):
    return build.contains_edges(built(spark, d)[1].symbols)


@query(of_type("tested_by"))
def tested_by(spark, d):
    return build.tested_by(imports_of(spark, d))


@query(of_type("depends_on"))
def depends_on(spark, d):
    return build.depends_on(imports_of(spark, d))


@query(f"{CODE} SELECT 'function:' || path || ':' || name AS id FROM functions WHERE NOT exported AND NOT contains(path, '.test.') AND 'function:' || path || ':' || name NOT IN (SELECT target FROM edges WHERE type = 'calls')")
def dead_code(spark, d):
    facts, s = built(spark, d)
    return build.dead_code(s.symbols, build.reference_edges(layers.calls(facts), "function", s.symbols, s.imported, "calls", 0.9))


FORMS = [p for (p,) in C.PATHS]
PATHS = f"p AS (SELECT 'app' || p_partkey || '/' || {literal(FORMS)}[p_partkey % {len(FORMS)} + 1] AS path FROM part)"
ASSET_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), {literal(form)}) THEN '{name}'" for name, form in P.ASSETS) + " END"


@query(f"WITH {PATHS} SELECT path, {ASSET_SQL} AS class FROM p")
def classify_assets(spark, d):
    p = asset_paths(spark, d, FORMS)
    return p.select("path", P.asset_class(p.path).alias("class"))


@query(f"WITH {PATHS} SELECT path FROM p WHERE list_contains({literal(list(SOURCE_EXTENSIONS))}, regexp_extract(path, '(\\.[^./]+)$', 1)) AND NOT list_has_any(list_slice(string_split(path, '/'), 1, -2), {literal(list(IGNORED_DIRS))}) AND NOT list_contains({literal(list(IGNORED_FILES))}, string_split(path, '/')[-1])")
def corpus_filter(spark, d):
    p = asset_paths(spark, d, FORMS)
    return p.where(P.scanned(p.path))


@query(f"{CODE} SELECT path, method, route FROM routed")
def routes(spark, d):
    return extract.routes(code_files(spark, d))


@query(f"{CODE} SELECT path, event, type FROM topics")
def events_pubsub(spark, d):
    return extract.events(code_files(spark, d))


@query(f"{CODE} SELECT DISTINCT 'file:' || path AS source, target FROM used")
def middleware(spark, d):
    files = code_files(spark, d)
    _, s = built(spark, d, files)
    return layers.Middleware().enrich(None, {"scope": s, "sources": files})[1].select("source", "target")


@query(f"{CODE} SELECT path, resource, type FROM accesses")
def data_access(spark, d):
    return extract.data_access(code_files(spark, d))


@query("SELECT 'db/part' || p_partkey || '.sql' AS path, unnest(['part' || p_partkey, 'stock' || p_partkey]) AS name FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT 'db/part' || p_partkey || '.prisma', unnest(['Part' || p_partkey, 'Stock' || p_partkey]) FROM part WHERE p_partkey % 10 = 5")
def schema_tables(spark, d):
    return extract.schema_tables(schema_files(spark, d))


@query("""SELECT 'src/line' || p_partkey || '.ts' AS path, unnest([1, 3, 8, 4, 6, 7, 1, 4, 8])::INTEGER AS line, unnest(['function', 'function', 'function', 'class', 'import', 'import', 'export', 'export', 'export']) AS kind, unnest(['f', 'g', 'h', 'K', './m', 'z', 'f', 'K', 'h']) || p_partkey AS name, unnest(['a,b', 'x', 'q', '', 'a,b', 'z', 'function', 'class', 'function']) AS detail, unnest([TRUE, FALSE, TRUE, TRUE, FALSE, TRUE, TRUE, TRUE, TRUE]) AS exported FROM part""")
def regex_signatures(spark, d):
    return extract.signatures(line_files(spark, d))


@query("""SELECT 'py/part' || p_partkey || '.py' AS path, unnest(['os', 'sys', '.m' || p_partkey, 'A' || p_partkey, 'f', 'g' || p_partkey]) AS name, unnest(['import', 'import', 'import', 'class', 'function', 'function']) AS kind, unnest([1, 1, 2, 5, 6, 8])::INTEGER AS line, unnest(['', '', 'y,z', 'B', 'self,a', 'q']) AS detail FROM part WHERE p_partkey % 10 <> 7
UNION ALL SELECT 'py/part' || p_partkey || '.py', 'SyntaxError', 'error', 0, '' FROM part WHERE p_partkey % 10 = 7""")
def python_ast(spark, d):
    return extract.python_signatures(python_files(spark, d))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


REFS = "CASE p_partkey % 5 WHEN 0 THEN 'src/a' || p_partkey || '.ts' WHEN 1 THEN 'function:src/a' || p_partkey || '.ts:f' WHEN 2 THEN 'weird:thing' || p_partkey WHEN 3 THEN 'file:x' || p_partkey ELSE 'table:a:b:c' || p_partkey END"


@query(f"WITH i AS (SELECT {REFS} AS ref FROM part), n AS (SELECT ref, CASE WHEN regexp_matches(ref, '^({'|'.join(P.ID_PREFIXES)}):') THEN ref ELSE 'file:' || ref END AS id FROM i) SELECT ref, id, CASE WHEN len(string_split(id, ':')) > 2 THEN array_to_string(list_slice(string_split(id, ':'), 2, -2), ':') ELSE string_split(id, ':')[2] END AS path FROM n")
def node_ids(spark, d):
    i = table(spark, d, "part").select(F.expr(REFS).alias("ref")).select("ref", P.node_id(F.col("ref")).alias("id"))
    return i.select("ref", "id", P.path_of_id(i.id).alias("path"))
