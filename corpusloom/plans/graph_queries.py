"""Graph core and propagation over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.model import rule_rows
from corpusloom.operators import graph, propagation
from corpusloom.plans.registry import query, values
from corpusloom.plans.tables import GRAPH, edges, named_edges, nodes, raw_edges

ENTRY = [("supplier:1",), ("supplier:3",), ("supplier:nowhere",)]


def entry_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRY, "id string")


@query(f"{GRAPH} SELECT id, type, name, file_path FROM nodes")
def graph_nodes(spark, d):
    return nodes(spark, d)


@query(f"{GRAPH} SELECT id, source, target, type, weight FROM edges")
def graph_edges_dedup(spark, d):
    return graph.first_write(named_edges(raw_edges(spark, d)), "id", F.lit(0))


@query(f"{GRAPH} SELECT id, type, name FROM nodes WHERE id = 'customer:7'")
def graph_point_lookup(spark, d):
    return nodes(spark, d).where(F.col("id") == "customer:7").select("id", "type", "name")


@query(f"{GRAPH} SELECT id, name FROM nodes WHERE type = 'module'")
def graph_nodes_by_type(spark, d):
    return nodes(spark, d).where(F.col("type") == "module").select("id", "name")


@query(f"{GRAPH} SELECT 'out' AS side, id FROM edges WHERE source = 'part:5' UNION ALL SELECT 'in', id FROM edges WHERE target = 'part:5'")
def graph_edges_of_node(spark, d):
    e = edges(spark, d)
    return graph.out_edges(e, "part:5").select(F.lit("out").alias("side"), "id").union(graph.in_edges(e, "part:5").select(F.lit("in"), "id"))


@query(f"{GRAPH} SELECT 'node' AS what, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def graph_type_counts(spark, d):
    n, e = nodes(spark, d).groupBy("type").agg(F.count("*").alias("n")), edges(spark, d).groupBy("type").agg(F.count("*").alias("n"))
    return n.select(F.lit("node").alias("what"), "type", "n").union(e.select(F.lit("edge"), "type", "n"))


NEIGHBORS = "both_ways AS (SELECT source AS id, target AS neighbor, type AS kind FROM edges UNION SELECT target, source, type FROM edges)"


@query(f"{GRAPH}, {NEIGHBORS} SELECT DISTINCT b.id, b.neighbor, n.type, n.name FROM both_ways b JOIN nodes n ON n.id = b.neighbor WHERE b.id IN ('nation:1', 'part:5', 'order:2')")
def graph_neighbors(spark, d):
    of = spark.createDataFrame([("nation:1",), ("part:5",), ("order:2",)], "id string")
    return graph.neighbors(nodes(spark, d), edges(spark, d), of)


@query(f"{GRAPH}, {NEIGHBORS} SELECT DISTINCT b.id, b.neighbor, n.type, n.name FROM both_ways b JOIN nodes n ON n.id = b.neighbor WHERE b.id IN ('nation:1', 'part:5') AND b.kind = 'imports'")
def graph_neighbors_by_type(spark, d):
    of = spark.createDataFrame([("nation:1",), ("part:5",)], "id string")
    return graph.neighbors(nodes(spark, d), edges(spark, d), of, "imports")


@query(f"{GRAPH}, b AS (SELECT b.*, n.name AS nn FROM (SELECT source AS id, target AS neighbor FROM edges WHERE type = 'contains' UNION SELECT target, source FROM edges WHERE type = 'contains') b JOIN nodes n ON n.id = b.neighbor) SELECT id, string_agg(nn, ',' ORDER BY nn) AS names FROM b GROUP BY id HAVING id LIKE 'region:%'")
def graph_neighbor_names(spark, d):
    n = nodes(spark, d)
    met = graph.neighbors(n, edges(spark, d), n.where("id like 'region:%'").select("id"), "contains")
    return met.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


@query(f"{GRAPH} SELECT id, type, CASE WHEN type = 'service' THEN name ELSE coalesce(name, '') END AS name FROM nodes WHERE type IN ('service', 'module') UNION ALL SELECT 'extra:' || r_regionkey, 'concept', r_name FROM region")
def graph_merge(spark, d):
    base = nodes(spark, d).where(F.col("type").isin("service", "module")).select("id", "type", "name")
    extra = nodes(spark, d).where("type = 'service'")
    more = extra.select("id", F.lit("concept").alias("type"), F.lit("loses").alias("name")).union(extra.select(F.concat(F.lit("extra:"), F.split("id", ":")[1]), F.lit("concept"), "name"))
    return graph.merge(base, more)


@query(f"{GRAPH}, gone AS (SELECT id FROM nodes WHERE type = 'resource' OR id = 'part:1'), n AS (SELECT count(*) AS nodes FROM nodes WHERE id NOT IN (SELECT id FROM gone)), e AS (SELECT count(*) AS edges FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)), a AS (SELECT count(*) AS n FROM edges) SELECT n.nodes, e.edges, a.n - e.edges AS removed_edges FROM n, e, a")
def graph_remove_node_cascade(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    left_n, left_e = graph.remove_nodes(n, e, n.where("type = 'resource' or id = 'part:1'").select("id"))
    counts = left_n.select(F.lit(1).alias("n"), F.lit(0).alias("e"), F.lit(0).alias("a")).union(left_e.select(F.lit(0), F.lit(1), F.lit(0))).union(e.select(F.lit(0), F.lit(0), F.lit(1)))
    return counts.agg(F.sum("n").alias("nodes"), F.sum("e").alias("edges"), (F.sum("a") - F.sum("e")).alias("removed_edges"))


@query(f"{GRAPH} SELECT id FROM nodes WHERE type = 'file' AND file_path NOT LIKE '%.test.ts'")
def graph_remove_files(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    return graph.remove_files(n, e, n.where("file_path like '%.test.ts'").select("file_path"))[0].where("type = 'file'").select("id")


@query(f"{GRAPH} SELECT id, CASE WHEN id IN ('region:1', 'region:2') THEN 'renamed' ELSE name END AS name, CASE WHEN id = 'region:1' THEN 'table' ELSE type END AS type FROM nodes WHERE type = 'service'")
def graph_update_node(spark, d):
    change = spark.createDataFrame([("region:1", "renamed", "table"), ("region:2", "renamed", None), ("region:99", "x", "y")], "id string, name string, type string")
    return graph.update_nodes(nodes(spark, d).where("type = 'service'"), change).select("id", "name", "type")


@query(f"{GRAPH}, x AS (SELECT source AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) SELECT id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM x GROUP BY id")
def graph_degree(spark, d):
    return graph.degrees(edges(spark, d))


@query(f"{GRAPH}, bad AS (SELECT source, target FROM edges WHERE type = 'contains' UNION ALL SELECT 'nation:999', 'customer:1') SELECT source, target FROM bad WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)")
def graph_existing_ends(spark, d):
    e = edges(spark, d).where("type = 'contains'").select("source", "target")
    return graph.with_ends(e.union(spark.createDataFrame([("nation:999", "customer:1")], "source string, target string")), nodes(spark, d))


@query(f"{GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT file_path) FROM nodes) AS files, (SELECT count(*) FROM e_raw) AS raw_edges")
def graph_size(spark, d):
    n = nodes(spark, d).agg(F.count("*").alias("nodes"), F.countDistinct("file_path").alias("files"))
    e = edges(spark, d).agg(F.count("*").alias("edges"))
    r = raw_edges(spark, d).agg(F.count("*").alias("raw_edges"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(n).join(one(e), "k").join(one(r), "k").select("nodes", "edges", "files", "raw_edges")


RULES = values("rules", "type, from_source, from_target", rule_rows())


@query(f"{GRAPH}, {RULES}, n AS (SELECT type, count(*) AS edges FROM edges GROUP BY type) SELECT type, from_source, from_target, coalesce(edges, 0) AS edges FROM rules LEFT JOIN n USING (type)")
def rules_table(spark, d):
    n = edges(spark, d).groupBy("type").agg(F.count("*").alias("edges"))
    return propagation.rules(spark).join(n, "type", "left").select("type", "from_source", "from_target", F.coalesce("edges", F.lit(0)).alias("edges"))


def _levels(direction: str, depth: int, min_weight: float, tests: bool = False) -> str:
    back = "SELECT e.target AS src, e.source AS dst, weight FROM edges e JOIN rules r USING (type) WHERE from_target"
    ahead = "SELECT e.source, e.target, weight FROM edges e" + (" JOIN rules r USING (type) WHERE from_source" if direction == "upstream" else "")
    step = ahead.replace("e.source,", "e.source AS src,").replace("e.target,", "e.target AS dst,") if direction == "downstream" else f"{back} UNION ALL {ahead}"
    ok = "" if tests else "AND NOT coalesce(regexp_matches(n.file_path, '\\.(test|spec)\\.'), FALSE)"
    starts = ", ".join(f"'{e[0]}'" for e in ENTRY)
    sql = f"{GRAPH}, {RULES}, moves AS (SELECT DISTINCT src, dst, weight FROM ({step}) m JOIN nodes n ON n.id = m.dst WHERE weight >= {min_weight} {ok}), l0 AS (SELECT n.id AS node, 1.0::DOUBLE AS p FROM nodes n WHERE n.id IN ({starts}) {ok})"
    for k in range(1, depth + 1):
        sql += f", l{k} AS (SELECT m.dst AS node, max(l.p * m.weight) AS p FROM l{k - 1} l JOIN moves m ON m.src = l.node GROUP BY m.dst)"
    every = " UNION ALL ".join(f"SELECT node, p, {k} AS d FROM l{k}" for k in range(depth + 1))
    return sql + f", lv AS ({every}), top AS (SELECT node, max(p) AS p FROM lv GROUP BY node), aff AS (SELECT t.node, t.p, min(lv.d) AS d FROM top t JOIN lv ON lv.node = t.node AND lv.p = t.p GROUP BY t.node, t.p)"


def _affected_sql(*a, **k) -> str:
    return _levels(*a, **k) + " SELECT node AS node_id, round(p, 6) AS probability, CAST(d AS INTEGER) AS distance FROM aff WHERE d > 0 AND node NOT IN (SELECT node FROM l0)"


def _affected(spark, d, *a, **k):
    t = propagation.trace(nodes(spark, d), named_edges(raw_edges(spark, d)), entry_points(spark), *a, **k)
    return t.affected.select("node_id", F.round("probability", 6).alias("probability"), F.col("distance").cast("int").alias("distance"))


@query(_affected_sql("upstream", 3, 0.0))
def propagate_upstream(spark, d):
    return _affected(spark, d, "upstream", 3)


#: Suppliers have no out-edges; what a nation holds is reached from it.
ABOVE = [("nation:1",), ("nation:2",), ("order:2",)]


@query(_affected_sql("downstream", 3, 0.0).replace(", ".join(f"'{e}'" for (e,) in ENTRY), ", ".join(f"'{e}'" for (e,) in ABOVE)))
def propagate_downstream(spark, d):
    t = propagation.trace(nodes(spark, d), named_edges(raw_edges(spark, d)), spark.createDataFrame(ABOVE, "id string"), "downstream", 3)
    return t.affected.select("node_id", F.round("probability", 6).alias("probability"), F.col("distance").cast("int").alias("distance"))


@query(_affected_sql("both", 3, 0.0))
def propagate_both(spark, d):
    return _affected(spark, d, "both", 3)


@query(_affected_sql("upstream", 3, 0.6))
def propagate_min_weight(spark, d):
    return _affected(spark, d, "upstream", 3, 0.6)


@query(_affected_sql("upstream", 3, 0.0, True))
def propagate_with_tests(spark, d):
    return _affected(spark, d, "upstream", 3, 0.0, True)


@query(_affected_sql("upstream", 2, 0.0))
def propagate_depth_by_budget(spark, d):
    from corpusloom.functions.tokens import depth_of_share

    return _affected(spark, d, "upstream", depth_of_share(0.82))


@query(_levels("upstream", 3, 0.0) + ", hi AS (SELECT p FROM aff WHERE d > 0 AND node NOT IN (SELECT node FROM l0)) SELECT count(*) AS affected, count(*) FILTER (WHERE p > 0.6) AS high_impact, round(coalesce(max(p), 0), 6) AS max_impact FROM hi")
def propagation_impact(spark, d):
    a = _affected(spark, d, "upstream", 3)
    return a.agg(F.count("*").alias("affected"), F.count_if(F.col("probability") > 0.6).alias("high_impact"), F.round(F.coalesce(F.max("probability"), F.lit(0.0)), 6).alias("max_impact"))


def _roots_sql(depth: int) -> str:
    sql = _levels("upstream", depth, 0.0)
    sql += ", f0 AS (SELECT node, p FROM l0), k0 AS (SELECT node, p FROM l0)"
    for k in range(1, depth + 1):
        sql += f", r{k} AS (SELECT f.node AS src, m.dst, f.p * m.weight AS p FROM f{k - 1} f JOIN moves m ON m.src = f.node LEFT JOIN k{k - 1} b ON b.node = m.dst WHERE b.p IS NULL OR f.p * m.weight > b.p)"
        sql += f", f{k} AS (SELECT dst AS node, max(p) AS p FROM r{k} GROUP BY dst), k{k} AS (SELECT node, max(p) AS p FROM (SELECT * FROM k{k - 1} UNION ALL SELECT * FROM f{k}) GROUP BY node)"
    relaxed = " UNION ".join(f"SELECT src FROM r{k}" for k in range(1, depth + 1))
    return sql + f" SELECT node AS node_id, round(p, 6) AS confidence, CAST(d AS INTEGER) AS distance FROM aff WHERE d > 0 AND node NOT IN (SELECT node FROM l0) AND node NOT IN ({relaxed})"


@query(_roots_sql(3))
def root_cause_candidates(spark, d):
    t = propagation.trace(nodes(spark, d), named_edges(raw_edges(spark, d)), entry_points(spark), "upstream", 3)
    return propagation.root_causes(t).select("node_id", F.round("confidence", 6).alias("confidence"), F.col("distance").cast("int").alias("distance"))


def _recall_sql() -> str:
    both, up = (_levels(x, 3, 0.5).removeprefix(f"{GRAPH}, {RULES}, ") for x in ("both", "upstream"))
    inner = lambda body: f"(WITH {body} SELECT node FROM aff WHERE d > 0)"
    starts = ", ".join(f"'{e[0]}'" for e in ENTRY)
    return f"{GRAPH}, {RULES} SELECT id, type FROM nodes WHERE id IN ({starts}) OR id IN {inner(both)} OR id IN {inner(up)}"


@query(_recall_sql())
def context_recall(spark, d):
    return propagation.recall_context(nodes(spark, d), named_edges(raw_edges(spark, d)), entry_points(spark))
