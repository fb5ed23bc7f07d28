from collections import defaultdict


import pytest

from corpusloom.llm import mixing
from tests.llm import awkward

DIR = "/root/testdata/sf0.01"


def targets(sizes):
    """Shares by weight; what stands above its cap stops there and the rest is shared anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("rows", ["real", "awkward"])
def test_targets_and_takings(spark, rows):
    docs = spark.read.parquet(f"{DIR}/documents.parquet") if rows == "real" else awkward.documents(spark)
    labels = spark.read.parquet(f"{DIR}/labels.parquet") if rows == "real" else awkward.labels(spark)
    out = mixing.mix(docs, labels).collect()
    assert len(out) == docs.count()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    want, taken, most = targets(sizes), defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= most[s] / 2 + 1e-6
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.key)
    again = sorted(mixing.mix(docs.repartition(5), labels).collect(), key=key)
    assert [(r.doc_id, r.taken) for r in again] == [(r.doc_id, r.taken) for r in sorted(out, key=key)]


def test_takes_the_smallest_keys(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 7)), "a" if i % 3 else "b") for i in range(400)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    by = defaultdict(list)
    for r in mixing.mix(docs, labels, buckets=8).collect():
        by[r.source].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.key)
        e = int(rows[0].target // rows[0].source_size)
        rest, before = rows[0].target - e * rows[0].source_size, 0
        for r in rows:
            assert r.taken == r.size * (e + (2 * before + r.size <= 2 * rest))
            before += r.size


def test_repeated_rows_across_the_end_of_the_budget(spark):
    rows = [(7, " ".join(["w"] * 10), "c")] * 60 + [(7, " ".join(["v"] * 10), "c")] * 3 + [(i, "z " * 9, "a") for i in range(60)] + [(None, "x y z", None)] * 40 + [(i, f"t{i} u", "b") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan, out = mixing.mix(docs).collect(), mixing.mixed(docs).collect()
    taken, got = defaultdict(int), defaultdict(int)
    for r in plan:
        taken[r.doc_id, r.source] += r.taken
    for r in out:
        got[r.doc_id, r.source] += len(r.text.split())
    assert {k: n for k, n in taken.items() if n} == got
    assert len({r.copies for r in plan if r.doc_id == 7 and r.source == "c"}) == 2


def test_empty(spark):
    docs = awkward.documents(spark)
    assert mixing.mix(docs.limit(0), awkward.labels(spark)).count() == 0
    assert mixing.mixed(docs).columns == docs.columns
