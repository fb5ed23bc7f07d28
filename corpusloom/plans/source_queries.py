"""Sources, validation and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import generators
from corpusloom.operators.extend import CachedService, Graph, TrigramService, enrich
from corpusloom.plans.build_queries import ASSET_SQL, CODE, FORMS, PATHS, TEXTS, built, imports_of
from corpusloom.plans.code_files import asset_paths, code_files
from corpusloom.plans.registry import query
from corpusloom.plans.tables import EDGES, NODES, edges, nodes, spread, spread_sql, table
from corpusloom.sources import corpus


@query("SELECT source || '/doc_' || doc_id || '.' || lang AS path, sha256(text) AS content_hash, strlen(text)::BIGINT AS bytes FROM documents")
def corpus_scan(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.concat("source", F.lit("/doc_"), "doc_id", F.lit("."), "lang").alias("path"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("bytes"))


@query(f"{CODE} SELECT path, target AS related, CASE kind WHEN 'ts' THEN '/* function ' WHEN 'go' THEN 'package main' ELSE 'package shop' END AS snippet FROM r")
def related_files(spark, d):
    files = code_files(spark, d)
    return corpus.related(imports_of(spark, d, files), files, 12)


@query(f"{CODE} SELECT DISTINCT path, path IN (SELECT path FROM f) AS found FROM (SELECT path FROM functions UNION ALL SELECT replace(path, '/m', '/gone') FROM classes)")
def context_load(spark, d):
    files = code_files(spark, d)
    _, s = built(spark, d, files)
    of = lambda kind, path: s.symbols.where(F.col("kind") == kind).select(F.concat_ws(":", "kind", path, "name").alias("node_id"))
    ids = of("function", F.col("path")).union(of("class", F.regexp_replace("path", "/m", "/gone")))
    return corpus.context(ids, files).select("path", (F.col("code") != "").alias("found"))


RAW = [("f1", "fault", 0.5), ("f2", "style", None), ("f3", "wrong", 0.5), (None, "fault", 0.2), ("f5", "fault", 1.5)]
FINDING = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("type", T.StringType(), False), T.StructField("confidence", T.DoubleType())])


REASONS = [(None,), (None,), ("type is unknown",), ("id is missing",), ("confidence is out of range",)]


@query(f"WITH {spread_sql('r', 'id, type, confidence', RAW)}, {spread_sql('x', 'reasons', REASONS)} SELECT CASE WHEN reasons IS NULL THEN 'accepted' ELSE 'rejected' END AS verdict, id || r.p AS id, coalesce(reasons, '') AS reasons FROM r JOIN x ON x.p = r.p")
def schema_reject(spark, d):
    raw = spread(spark, d, RAW, "k string, type string, confidence double").select(F.concat("k", F.col("p").cast("string")).alias("id"), "type", "confidence")
    rules = {"type is unknown": F.col("type").isin("fault", "pattern", "insight", "style"), "confidence is out of range": F.col("confidence").between(0, 1)}
    ok, bad = corpus.validate(raw, FINDING, rules, {"confidence": 0.5})
    return ok.select(F.lit("accepted").alias("verdict"), "id", F.lit("").alias("reasons")).union(bad.select(F.lit("rejected"), "id", F.array_join("reasons", ",")))


STATUS = [(" M src/a.ts",), ("?? new.ts",), ("A  added.ts",), ("D  gone.ts",), ("R  old.ts -> new2.ts",), ("",)]
STATUSES = [("modified", "src/a.ts"), ("untracked", "new.ts"), ("added", "added.ts"), ("deleted", "gone.ts"), ("renamed", "new2.ts"), (None, None)]


@query(f"WITH {spread_sql('r', 'status, path', STATUSES)} SELECT status, path || p AS path FROM r WHERE path IS NOT NULL")
def porcelain_status(spark, d):
    s = spread(spark, d, STATUS, "v string")
    return corpus.porcelain(s.select(F.when(F.col("v") == "", "").otherwise(F.concat("v", F.col("p").cast("string"))).alias("value")))


@query("SELECT p_brand || '-' || p_partkey AS id, p_name AS description, (p_partkey % 3)::INTEGER AS n_files FROM part")
def batch_tasks(spark, d):
    """A file of tasks for each brand, read back."""
    p = table(spark, d, "part")
    files = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("p_partkey") % 3).cast("int"))
    task = F.struct(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("description"), F.when(F.size(files) > 0, files).alias("files"))
    return corpus.tasks(p.groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(task).alias("tasks"))).alias("value")).select("value"))


@query("SELECT 'plan-' || item_id AS id, text FROM benchmark WHERE item_id = 7")
def plan_by_id(spark, d):
    from corpusloom.shared import scratch

    path = scratch(spark, "plans")
    corpus.save_plans(table(spark, d, "benchmark").select(F.concat(F.lit("plan-"), "item_id").alias("id"), "text"), path)
    return corpus.plan_by_id(spark, path, "plan-7", "id string, text string").select("id", "text")


@query(f"WITH {NODES}, {EDGES} SELECT 'nodes' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges")
def memory_roundtrip(spark, d):
    from corpusloom.shared import scratch

    path = scratch(spark, "memory")
    corpus.save_memory({"nodes": nodes(spark, d), "edges": edges(spark, d)}, path)
    back = corpus.load_memory(spark, path, ["nodes", "edges"])
    return back["nodes"].select(F.lit("nodes").alias("name")).union(back["edges"].select(F.lit("edges"))).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS id, 's' || s_suppkey AS provider, 'trigram' || s_nationkey AS embedding FROM supplier")
def yaml_keys(spark, d):
    s = table(spark, d, "supplier")
    text = F.concat(F.lit("llm:\n  provider: s"), F.col("s_suppkey").cast("string"), F.lit(" # local\n  model: 'tiny'\nembedding:\n  provider: trigram"), F.col("s_nationkey").cast("string"), F.lit("\n"))
    return s.select(F.col("s_suppkey").alias("id"), corpus.read_yaml_key(text, "llm", "provider").alias("provider"), corpus.read_yaml_key(text, "embedding", "provider").alias("embedding"))


class Assets:
    name, layer, needs = "assets", "A", ("paths",)

    def enrich(self, graph, inputs):
        from corpusloom.functions import paths as P

        p = inputs["paths"].select("path", P.asset_class(F.col("path")).alias("type")).where("type is not null")
        return p.select(F.concat_ws(":", "type", "path").alias("id"), "type"), None


class Vectors:
    name, layer, needs = "vectors", "C", ("vectors",)

    def enrich(self, graph, inputs):
        raise AssertionError("an enricher without its input must not run")


@query(f"WITH {NODES}, {PATHS}, a AS (SELECT type FROM nodes UNION ALL SELECT {ASSET_SQL} FROM p) SELECT type, count(*) AS n FROM a WHERE type IS NOT NULL GROUP BY type")
def enrich_layers(spark, d):
    g = enrich(Graph(nodes(spark, d).select("id", "type"), edges(spark, d)), [Vectors(), Assets()], {"paths": asset_paths(spark, d, FORMS)})
    return g.nodes.groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {TEXTS} SELECT id, count(DISTINCT g) > 0 AS embedded FROM g GROUP BY id")
def cached_embedding(spark, d):
    texts = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    service = CachedService(TrigramService(), TrigramService().embed(texts.where("id % 2 = 0")))
    return service.embed(texts).groupBy("id").agg((F.count("*") > 0).alias("embedded"))




@query("""SELECT page_id, position, scheme, host FROM (SELECT page_id, 0 AS position, regexp_extract(url, '^(\\w+)://([^/?#]+)', 1) AS scheme, regexp_extract(url, '^(\\w+)://([^/?#]+)', 2) AS host FROM pages) WHERE host <> ''""".replace("\\\\", "\\"))
def url_matches(spark, d):
    """A generator called in a lateral join; the pattern's groups are its columns."""
    generators.register(spark)
    return spark.sql(r"SELECT page_id, m.position, m.scheme, m.host FROM {pages} p, LATERAL matches(p.url, r'^(?P<scheme>\w+)://(?P<host>[^/?#]+)') m", pages=table(spark, d, "pages"))


@query("SELECT user_id AS key, prev + 1 AS first, event_id - 1 AS last FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) WHERE event_id > prev + 1")
def event_gaps(spark, d):
    generators.register(spark)
    rows = table(spark, d, "events").select("user_id", F.col("event_id").cast("long").alias("event_id"))
    return spark.sql("SELECT key, first, last FROM gaps(TABLE({rows}))", rows=rows)
