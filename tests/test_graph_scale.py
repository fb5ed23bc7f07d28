"""The graph of files meets in a few narrow exchanges, whatever the number of layers."""

from corpusloom.operators import graph, layers, outline
from corpusloom.operators.extend import Graph, enrich
from corpusloom.plans import code_queries
from corpusloom.shared import store
from tests.test_owned import DIR, SCHEMA, F, by_joins, repository, shuffled


def edges_of(graph):
    return sorted(tuple(r) for r in graph.edges.select("source", "target", "type", "weight").collect())


def test_as_by_joins_with_and_without_marks(spark):
    files = repository(spark)
    want = by_joins(files)
    assert edges_of(layers.graph_from_files(files)) == want
    assert edges_of(layers.graph_of(store(outline.facts(files), "facts"), files)) == want
    assert edges_of(layers.graph_of(store(outline.facts(files), "facts"))) == [e for e in want if e[2] not in ("routes", "publishes", "subscribes", "middleware", "reads_from", "writes_to")]


def test_files_of_many_imports_and_no_files(spark):
    n = 3000
    user = "".join(f"import {{ f{i} }} from './m{i}';\n" for i in range(n)) + "function all() { " + " ".join(f"f{i}();" for i in range(n)) + " }\n"
    files = spark.createDataFrame([("u.ts", user)] + [(f"m{i}.ts", f"export function f{i}() {{}}\n") for i in range(n)], SCHEMA)
    got = {r.type: r["count"] for r in layers.graph_from_files(files).edges.groupBy("type").count().collect()}
    assert got == {"contains": n + 1, "exports": n, "imports": n, "depends_on": n, "calls": n}
    assert layers.graph_from_files(files.limit(0)).edges.count() == 0


def test_graph_edges_meet_in_few_exchanges(spark):
    assert len(shuffled(code_queries.code_graph_edges(spark, DIR))) <= 6


def test_no_text_is_shuffled(spark):
    files = store(repository(spark), "files")
    made = layers.graph_from_files(files).edges
    assert not any("content" in line for line in shuffled(made))


def test_layers_meet_in_one_aggregation_as_one_after_the_other(spark):
    class Adds:
        layer, needs = "A", ()

        def __init__(self, name, rows):
            self.name, self.rows = name, rows

        def enrich(self, graph, inputs):
            return table(self.rows), None

    table = lambda rows: spark.createDataFrame(rows, "id string, name string")
    parts = [[("a", "z"), ("b", "y")], [("a", "a"), ("c", "q"), ("c", "p")], [("b", "b"), ("c", "a"), ("d", None)], [("d", "d")]]
    found = enrich(Graph(table(parts[0]), None), [Adds(str(i), p) for i, p in enumerate(parts[1:])], {})
    want = table(parts[0])
    for p in parts[1:]:
        want = graph.merge(want, table(p))
    assert sorted(map(tuple, found.nodes.collect())) == sorted(map(tuple, want.collect())) and found.edges is None
    assert len(shuffled(found.nodes)) == 1
