"""What keeps cosine pairs, neighbours and clusters within bounds as the vectors grow."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import similarity


def some(spark, n, width=6, copies=3):
    """Vectors of which some are equal, with ids as text that repeat once, and two groups."""
    v = np.random.default_rng(7).normal(size=(n // copies + 1, width)).round(2)
    rows = [(f"v{i}", v[i % len(v)].tolist(), i % 2) for i in range(n)] + [("v1", v[2].tolist(), 1)]
    return spark.createDataFrame(rows, "id string, vector array<double>, g int")


def rounded(df):
    return sorted((r.a, r.b, round(r.cosine, 6)) for r in df.collect())


def test_nearest_and_linked_say_what_the_pairs_say(spark):
    v = some(spark, 90)
    for within in (None, "g"):
        for block in (None, 17):
            pairs = similarity.cosine_pairs(v, 0.8, within, block).withColumn("cosine", F.round("cosine", 9))
            of = {p[:2]: p[2] for p in rounded(similarity.nearest(v, 0.8, 4, within, block))}
            sides = {}
            for a, b, c in rounded(pairs):
                sides.setdefault(a, []).append((-c, b))
                sides.setdefault(b, []).append((-c, a))
            # neighbours that tie but for the last bits of their cosines may stand for each other
            assert all(of[x] >= min(-sorted(sides[n])[:4][-1][0] for n in x) - 1e-6 for x in of)
            assert all(sum(n in x for x in of) >= min(4, len({o for _, o in s})) - 1 for n, s in sides.items())
            want = {tuple(r) for r in similarity.clusters(pairs, 0.8).collect()}
            assert want == {tuple(r) for r in similarity.grouped(similarity.linked(v, 0.8, within, block)).collect()}


def test_cells_give_rows_by_vectors_not_by_pairs(spark):
    """400 equal vectors have 79,800 pairs."""
    v = spark.range(400).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    assert similarity.linked(v, 0.9).count() == 399
    assert similarity.linked(v, 0.9, rows_a_block=50).count() < 400 * 9
    best = {(r.a, r.b) for r in similarity.nearest(v, 0.9, 2).collect()}
    assert {(0, 1), (0, 2), (1, 2), (0, 399), (1, 399)} <= best and len(best) == 1 + 2 * 398


def test_vectors_are_moved_by_a_bounded_number_of_copies(spark):
    """Blocks grow with the table: 60,000 vectors go to 12 cells each, not to 30."""
    v = spark.range(60_000).select("id", F.array(F.rand(1), F.rand(2)).alias("vector"))
    plan = similarity.cosine_pairs(v, 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64(id" in plan and ", 12)" in plan
