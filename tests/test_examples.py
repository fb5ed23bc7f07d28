"""Worked examples with known numbers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions import text, tokens, vector
from corpusloom.model import NODE_TYPES, rule_rows
from corpusloom.operators import caches, extend, extract, graph, metrics, patch, propagation, semantic, similarity, sync
from corpusloom.operators.components import connected

NODES = "id string, type string, name string, file_path string"
EDGES = "id string, source string, target string, type string, weight double"


def graph_of(spark, edges, tests=()):
    ids = sorted({x for a, b, *_ in edges for x in (a, b)})
    n = spark.createDataFrame([(i, "file", i, i + (".test.ts" if i in tests else ".ts")) for i in ids], NODES)
    return n, spark.createDataFrame([(f"{a}--{t}--{b}", a, b, t, w) for a, b, t, w in edges], EDGES)


def reach(spark, edges, entry, tests=(), **options):
    t = propagation.trace(*graph_of(spark, edges, tests), spark.createDataFrame([(entry,)], "id string"), **options)
    return {r.node_id: (round(r.probability, 9), r.distance, r.path) for r in t.affected.collect()}


CHAIN = [("A", "B", "calls", 0.8), ("B", "C", "calls", 0.8)]


def test_propagation(spark):
    assert set(reach(spark, CHAIN, "B")) == {"A"}
    assert set(reach(spark, CHAIN, "C", max_depth=1)) == {"B"}
    assert reach(spark, CHAIN, "C", min_weight=0.9) == {}
    assert set(reach(spark, CHAIN, "B", direction="both")) == {"A", "C"}
    assert reach(spark, CHAIN, "C") == {"B": (0.8, 1, ["C", "B"]), "A": (0.64, 2, ["C", "B", "A"])}
    test = [("T", "S", "imports", 0.7)]
    assert reach(spark, test, "S", tests=("T",)) == {} and set(reach(spark, test, "S", tests=("T",), include_tests=True)) == {"T"}
    with pytest.raises(ValueError):
        reach(spark, CHAIN, "A", direction="sideways")


def test_root_causes(spark):
    t = propagation.trace(*graph_of(spark, CHAIN), spark.createDataFrame([("C",)], "id string"))
    assert [(r.node_id, round(r.confidence, 2)) for r in propagation.root_causes(t).collect()] == [("A", 0.64)]


def test_rules():
    assert len(rule_rows()) == 31 and len({r[0] for r in rule_rows()}) == 31 and len(NODE_TYPES) == 16


def test_merge_is_idempotent(spark):
    n, e = graph_of(spark, CHAIN)
    assert sorted(graph.merge(n, n).collect()) == sorted(n.collect()) and sorted(graph.merge(e, e).collect()) == sorted(e.collect())
    left, kept = graph.remove_nodes(n, e, spark.createDataFrame([("B",)], "id string"))
    assert left.count() == 2 and kept.count() == 0
    last = graph.last_write(spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string"), "id", F.col("v"))
    assert [tuple(r) for r in last.collect()] == [(1, "b")]


def test_similarity(spark):
    v = spark.createDataFrame([("a", "t", [1.0, 0.0, 0.0]), ("b", "t", [0.8, 0.6, 0.0]), ("c", "t", [0.0, 1.0, 0.0]), ("d", "t", [1.0, 0.0, 0.0]), ("z", "t", [0.0, 0.0, 0.0])], "id string, g string, vector array<double>")
    pairs = similarity.cosine_pairs(v, 0.7, within="g")
    got = {(r.a, r.b): similarity_band for r in pairs.select("a", "b", similarity.band(F.col("cosine")).alias("t")).collect() for similarity_band in [r.t]}
    assert got == {("a", "d"): "similar_to", ("a", "b"): "related", ("b", "d"): "related"}
    same = spark.createDataFrame([(f"n{i}", [1.0, 0.0]) for i in range(8)], "id string, vector array<double>")
    every = similarity.cosine_pairs(same, 0.7, rows_a_block=3)
    assert every.count() == 28 and similarity.top_neighbours(every).count() < 28
    two = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [0.0, 1.0]), ("e", [0.7, 0.7])], "id string, vector array<double>")
    found = similarity.clusters(similarity.cosine_pairs(two, 0.8))
    assert found.select("cluster").distinct().count() == 2 and found.count() == 4


def test_vector_guards(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0]), ([], []), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vector.cosine(df.a, df.b)).collect()] == [0.0, 0.0, 0.0]
    assert vector_hash(spark, "abc") == 440920331 and vector_hash(spark, "😀") == fnv("😀")


def vector_hash(spark, s):
    return spark.createDataFrame([(s,)], "s string").select(vector.fnv1a(F.col("s"))).first()[0]


def fnv(s):
    h = 2166136261
    for unit in memoryview(s.encode("utf-16-le")).cast("H"):
        h = (h ^ unit) * 16777619 % (1 << 32)
    return h


def test_token_ratios(spark):
    want = {"glm-5.1": 2.5, "kimi-k2.6": 2.6, "deepseek-x": 2.8, "gpt-5": 3.6, "gpt-4o": 4.2, "claude-3": 3.8, "other": 4.0}
    df = spark.createDataFrame([(m,) for m in want], "m string")
    assert {r.m: r.r for r in df.select("m", tokens.ratio(df.m).alias("r")).collect()} == want
    t = spark.createDataFrame([("",), (None,), ("a",), ("abcdefgh",), ("中文中文",), ("a😀中",)], "t string")
    assert [r[0] for r in t.select(tokens.estimate(t.t)).collect()] == [0, 0, 1, 2, 2, 2]


@pytest.mark.parametrize(("used", "name"), [(6999, "none"), (7000, "reduce_depth"), (8000, "disable_search"), (9000, "core_only"), (9500, "prompt_user")])
def test_budget_levels(spark, used, name):
    assert spark.range(1).select(tokens.level(F.lit(used) / 10000)).first()[0] == name


def test_budget_exhausted(spark):
    usage = spark.createDataFrame([(60,), (40,)], "tokens long")
    tokens.require_budget(usage, 101)
    with pytest.raises(RuntimeError):
        tokens.require_budget(usage, 100)


def test_sync_equals_rebuild(spark):
    s = "path string, hash string, sig string"
    old = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("c", "1", "x"), ("d", "1", "x")], s)
    new = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x"), ("c", "2", "y"), ("e", "1", "z")], s)
    build = lambda f: f.select("path", F.upper("sig").alias("node"))
    diff = sync.snapshot_diff(old, new, "path", "hash", ["sig"])
    assert {r.path: r.level for r in diff.collect()} == {"a": "NONE", "b": "COSMETIC", "c": "STRUCTURAL", "d": "deleted", "e": "added"}
    depends = spark.createDataFrame([("a", "c")], "path string, on string")
    assert sorted(sync.sync(build(old), new, diff, depends, "path", build).collect()) == sorted(build(new).collect())
    assert {r.path for r in sync.affected(diff, depends, "path").collect()} == {"a", "c", "d", "e"}
    forced = sync.snapshot_diff(old, new, "path", "hash", ["sig"], force=True)
    assert {r.level for r in forced.where("path in ('a', 'b')").collect()} == {"STRUCTURAL"}


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "x double")
    assert tuple(metrics.distribution(none, "x").first()) == (0, 0.0, 0.0, 0.0, 0.0)
    assert none.agg(metrics.rate(F.count("x"), F.count("*"))).first()[0] == 0.0


def test_batches(spark):
    pairs = spark.createDataFrame([("p", f"a{i:02}", f"b{i:02}") for i in range(30)] + [("q", "a", f"b{i:02}") for i in range(30)], "path string, a string, b string")
    sizes = {}
    for r in semantic.batches(pairs).collect():
        sizes.setdefault((r.path, r.batch), []).append((r.a, r.b))
    assert all(len(v) <= 25 and len({x for p in v for x in p}) <= 15 for v in sizes.values())
    assert len(sizes[("p", 0)]) == 7 and len(sizes[("q", 0)]) == 14


def test_components_of_text_ids(spark):
    links = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y")], "a string, b string")
    assert {r.node: r.root for r in connected(links).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_json_repair():
    assert extract.repair_json('{"a": [1, {"b": "c') == '{"a": [1, {"b": "c"}]}'
    assert extract.repair_json('```json\n[1]\n```') == "[1]"


def test_text_masks(spark):
    df = spark.createDataFrame([('token = "abcdef0123456789" and sk-abcdefghijk',)], "t string")
    assert df.select(text.mask_secrets(df.t)).first()[0] == "[masked] and [masked]"
    c = spark.createDataFrame([("#!/x\n// one\n//  two\n/* three */\n// four\ncode",)], "c string")
    assert c.select(text.leading_comment(c.c)).first()[0] == "!/x one two"


def test_apply_replaces_first_place_only(spark):
    df = spark.createDataFrame([("a b a", "a", "c")], "cur string, old string, new string")
    assert df.select(patch.apply(df.cur, df.old, df.new)).first()[0].result == "c b a"


def test_recorder_and_review(spark):
    r = extend.Recorder()
    assert r.run("ok", lambda: 3) == 3
    with pytest.raises(ZeroDivisionError):
        r.run("bad", lambda: 1 / 0)
    assert {x.agent: x.success for x in r.table(spark).collect()} == {"ok": True, "bad": False}
    assert extend.review(spark.range(4), lambda p: p.where("id > 1")).count() == 2


def test_lru(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3), ("z", 0)], "k string, t int")
    assert [tuple(r) for r in caches.lru(a, "k", "t", 2).orderBy("k").collect()] == [("x", 3), ("y", 2)]


def test_strip_pages_has_every_page(spark, tmp_path):
    rows = [(1, "<p>plain</p>"), (2, "<b>a &lt;b&gt; &amp;quot; &quot;c&#39;s&#x27;</b>&nbsp;"), (3, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r.page_id: r.text_md5 for r in catalog.QUERIES["strip_pages"](spark, str(tmp_path)).collect()}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert found == {1: md5("plain"), 2: md5("a <b> &quot; \"c's'"), 3: None}
    real = "/root/testdata/sf0.01"
    assert catalog.QUERIES["strip_pages"](spark, real).count() == spark.read.parquet(f"{real}/pages.parquet").count()


def test_mask_secrets_has_every_document(spark, tmp_path):
    texts = {1: 'TOKEN = "9233A8ECAB"', 2: "Bearer abcdefgh12", 3: "PASSWORD: abcdefgh", 4: "sk-abcdefgh", 5: "plain", 6: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.masked_md5 for r in catalog.QUERIES["mask_secrets"](spark, str(tmp_path)).collect()}
    assert found == {i: hashlib.md5((t if i > 4 else "[masked]").encode()).hexdigest() for i, t in texts.items()}
    real = "/root/testdata/sf0.01"
    assert catalog.QUERIES["mask_secrets"](spark, real).count() == spark.read.parquet(f"{real}/documents.parquet").count()


def test_batches_go_on_from_one_arrow_batch_to_the_next(spark):
    pairs = [(p, f"a{i * s % 97:02}", f"b{i % m:02}") for p, s, m in (("p", 1, 97), ("q", 5, 2), ("r", 3, 1)) for i in range(90)]
    want = set()
    for path in "pqr":
        k, n, names = 0, 0, set()
        for p, a, b in sorted(x for x in pairs if x[0] == path):
            if n and (n >= 25 or len(names | {a, b}) > 15):
                k, n, names = k + 1, 0, set()
            n, names = n + 1, names | {a, b}
            want.add((p, a, b, k))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for records in (1, 7, 10_000):
            spark.conf.set(key, str(records))
            assert {tuple(r) for r in semantic.batches(spark.createDataFrame(pairs, "path string, a string, b string")).collect()} == want
    finally:
        spark.conf.set(key, before)


def test_pair_batches_takes_every_pair(spark):
    real = "/root/testdata/sf0.01"
    found = catalog.QUERIES["pair_batches"](spark, real)
    every = spark.read.parquet(f"{real}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct()
    assert {(int(r.a), int(r.b)) for r in found.collect()} == {tuple(r) for r in every.collect()} and found.count() == every.count()
    assert found.select("path").distinct().count() > 1 and found.agg(F.max("batch")).first()[0] > 0


def test_token_estimate_by_model_has_every_text(spark):
    real = "/root/testdata/sf0.01"
    items = {r.item_id for r in spark.read.parquet(f"{real}/benchmark.parquet").select("item_id").collect()}
    found = catalog.QUERIES["token_estimate_by_model"](spark, real).collect()
    models = {r.model for r in found}
    assert len(models) == 13 and len(found) == 13 * len(items) and {(r.item_id, r.model) for r in found} == {(i, m) for i in items for m in models}
