import random

import numpy as np
import pytest

from corpusloom.llm import jaccard
from corpusloom.operators import components
from tests.llm import awkward


def shingle_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * min(len(sets[i]), len(sets[j])) >= 80 * max(len(sets[i]), len(sets[j])):
                k = len(sets[i] & sets[j])
                if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows) if d is not None)


def got(docs, **options):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.group(docs, **options).collect() if r.doc_id is not None)


def near_copies(seed=5, groups=6, size=40, words=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(vocab) for _ in range(30)]
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(words)]
        for k in range(size if g < 2 else 4):
            t = list(base)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(50)}"
            rows.append(" ".join(t[: len(t) - rng.randrange(6)]))
    rows += [" ".join(passage + [rng.choice(vocab) for _ in range(rng.randrange(2, 40))]) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("options", [{}, {"longest": 3, "chunk_sets": 7, "most_combined": 2}, {"longest": 4, "sketch_bits": 4, "most_combined": 50}])
def test_against_brute_force(spark, options):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(docs, **({"sketch_bits": 10} | options)) == brute(rows)


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_tables(spark):
    docs = awkward.documents(spark)
    assert got(docs, sketch_bits=12) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard.group(docs.limit(0), sketch_bits=12).count() == 0
    kept = jaccard.keep_one(docs, sketch_bits=12)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 1, 2, 3, 4, 5, 7}
    assert kept.where("doc_id = 6").count() == 0


def test_prefixes_meet():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 40, 1 << 8).astype(np.uint16)
    for _ in range(300):
        base = np.unique(rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64))
        other = np.unique(np.r_[rng.choice(base, max(1, int(len(base) * rng.uniform(0.8, 1))), replace=False), rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)])
        if not jaccard._linked(base, other):
            continue
        (ka, na, wa), (kb, nb, wb) = (jaccard.keys_of(s, counts, 20, 6) for s in (base, other))
        met = {(k, n) for k, n in zip(ka.tolist(), na.tolist())} & {(k, n) for k, n in zip(kb.tolist(), nb.tolist())}
        assert any(n < 2 or wa or wb for _, n in met)
        assert (na.any() and nb.any()) or len(met) > 1 or min(len(base), len(other)) == 1


def test_a_full_sketch_still_tells_rare_tokens():
    rng = np.random.default_rng(3)
    counts = rng.integers(900_000, 1_100_000, 1 << 10).astype(np.uint64)
    counts[:40] = 50_000_000
    table, frequent = jaccard.levels(counts), int(jaccard.levels(np.array([2 * counts.mean() + 64]))[0])
    tokens = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    keys, kinds, wide = jaccard.keys_of(tokens, table, frequent, 24)
    assert not wide and (kinds == 0).sum() > 50
    hot = np.unique((rng.integers(0, 2**50, 30).astype(np.uint64) << np.uint64(10)) | np.arange(30, dtype=np.uint64))
    assert (jaccard.keys_of(hot, table, frequent, 24)[1] > 0).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 300)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(-5, 7), (7, -5), (9, 9)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    found = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_lists_cut_at_every_position(spark):
    rows = [(key, kind, False, False, 50, 100 * key + i) for key, kind, size in ((1, 0, 2), (2, 1, 11), (3, 0, 1), (4, 2, 9), (5, 1, 2), (6, 0, 1)) for i in range(size)]
    entries = spark.createDataFrame(rows, "key long, kind byte, narrow boolean, pure boolean, n int, sid long")
    batch, parts = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.shuffle.partitions")
    before = spark.conf.get(batch)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        for records in range(1, len(rows) + 1):
            spark.conf.set(batch, str(records))
            found = jaccard.lists(entries, 4).collect()
            assert {(r.a, r.b) for r in found if r.list is None} == {(100, 101), (500, 501)}, records
            members = {(r.list, r.a) for r in found if r.list is not None}
            assert members == {(key ^ kind, sid) for key, kind, _, _, _, sid in rows if key in (2, 4)}, records
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set(batch, before)
