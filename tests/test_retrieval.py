"""Set-similarity search against all pairs."""

import random

import pytest

from corpusloom.operators import retrieval

SCHEMA = "id long, tokens array<string>"


def brute(left, right):
    for i, a in left:
        for j, b in right:
            a_, b_ = set(a or []), set(b or [])
            if a_ and b_:
                yield i, j, len(a_ & b_) / len(a_ | b_)


def sets(rng, n, vocabulary, start=0, hot=True):
    out = []
    for i in range(n):
        t = rng.sample(vocabulary, rng.choice([1, 1, 2, 5, 10, 12, 20]))
        out.append((start + i, list(dict.fromkeys(t + (["every"] if hot else [])))))
    return [*out, (start + n, []), (start + n + 1, None), (start + n + 2, ["every"]), (start + n + 3, ["none but here"])]


@pytest.mark.parametrize("least", [0.1, 0.2, 0.5, 2 / 3, 1.0])
def test_pairs_as_brute_force(spark, least):
    rng = random.Random(int(least * 100))
    words = [f"w{i}" for i in range(40)]
    left, right = sets(rng, 120, words), sets(rng, 90, words[:25], 1000)
    got = {(r.left_id, r.right_id): r.jaccard for r in retrieval.overlaps(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), least).collect()}
    want = {(i, j): s for i, j, s in brute(left, right) if s >= least - 1e-12}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_nearest_takes_the_earliest_of_the_best(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(22)]
    left, right = sets(rng, 60, words), sets(rng, 60, words, 100)
    best = {}
    for i, j, s in brute(left, right):
        if s >= 0.5 and (i not in best or s > best[i][0] + 1e-12):
            best[i] = (s, j)
    got = {r.query_id: (r.score, r.entry_id) for r in retrieval.nearest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()}
    assert got == best


def test_a_token_in_every_set_pairs_no_large_ones(spark):
    """A token that all sets hold gives no quadratic join: prefixes of larger sets don't reach it."""
    rows = [(i, ["every", *(f"x{i}_{k}" for k in range(9))]) for i in range(400)]
    left, right = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i + 1000, t) for i, t in rows], SCHEMA)
    frequency = right.selectExpr("explode(tokens) as t").groupBy("t").count().toDF("t", "f")
    a, b = (retrieval._prefixes(retrieval._known(x, frequency), 0.5) for x in (left, right))
    assert a.where("t = 'every'").count() == 0 and a.select("t").join(b.select("t"), "t").count() <= 400 * 6
    assert retrieval.overlaps(left, right, 0.5).count() == 400


def test_no_floor_no_search(spark):
    with pytest.raises(ValueError):
        retrieval.overlaps(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA), 0.0)
    assert retrieval.overlaps(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, ["a"])], SCHEMA), 0.1).count() == 0


def test_rounds_move_no_edge_of_an_adjacency(spark):
    from corpusloom.operators import propagation
    from corpusloom.plans.graph_queries import entry_points
    from corpusloom.plans.tables import edges, nodes

    n, e, entry = nodes(spark, "/root/testdata/sf0.001"), edges(spark, "/root/testdata/sf0.001"), entry_points(spark)
    near = propagation.adjacency(n, e, "both", 0.5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        front = near.selectExpr("dst as src").distinct()
        plan = front.join(near, "src")._jdf.queryExecution().executedPlan().toString()
        scan = [line for line in plan.split("\n") if "corpusloom_moves" in line and "Bucketed: true" in line]
        assert scan and "SelectedBucketsCount: 4 out of 4" in plan
        assert plan.count("Exchange hashpartitioning(src") <= 1  # the frontier's
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain, kept = (propagation.trace(n, e, entry, "both", 3, 0.5, adjacent=a) for a in (None, near))
    rows = lambda t: {tuple(map(str, r)) for r in t.affected.collect()}
    assert rows(plain) == rows(kept) and rows(plain)
    assert {r.node_id for r in plain.relaxed.collect()} == {r.node_id for r in kept.relaxed.collect()}
