import itertools
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import interaction, queries
from tests.llm import awkward

NAMES = ("part", "filter_order", "step", *interaction.COUNTS)


def fails(rows):
    """The mask of every (doc_id, text, lang), by the definition."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        alone = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)))
        out.append((*alone, i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)))
    return out


def brute(rows, labels):
    """Every order run from its beginning."""
    masks, good, toxic, out = fails(rows), {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}, set()
    for part in {lang or "" for *_, lang in rows}:
        docs = [(m, i) for m, (i, _, lang) in zip(masks, rows, strict=True) if (lang or "") == part]
        steps, total = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, gone = docs, []
            for k, f in enumerate(order):
                b = "ABCDE".index(f)
                removed = [x for x in left if x[0][b]]
                left = [x for x in left if not x[0][b]]
                steps.append(("".join(order), k + 1, f, len(left), len(removed), sum(m[b] for m, _ in gone), sum(m[b] and sum(m) == 1 for m, _ in docs), sum(i in good for _, i in removed), sum(i in toxic for _, i in removed)))
                total[f] += len(removed)
                gone += removed
        out |= {(part, o, k, *s, total[f]) for o, k, f, *s in steps}
    return out


def got(docs, labels):
    rows = interaction.audit_texts(docs, labels).select(*NAMES).collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for i in interaction.swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n)))


def test_as_brute_force(spark):
    good = " ".join(f"word{i}" for i in range(120))
    texts = [good, good + " #", "SHOUT " * 120, "short", good.upper(), good + " $", "the " * 150, None, "", good, "a|b", good + " end"]
    rows = [(i if i % 9 else None, texts[i * 7 % 12], [None, "", "en", "de"][i % 4]) for i in range(300)]
    rows += rows[3:8] + [(12, good, "fr"), (12, good, "fr"), (2, good, "de"), (2, good, None)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 300, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (6, None, 1), (9, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(rows, labels)
    assert got(docs, said) == want and any(r[8] for r in want) and any(r[7] for r in want)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert set(con.execute(f"SELECT {', '.join(NAMES)} FROM ({queries.SQL['op11_transposition_audit']})").fetchall()) == want


def test_shapley_shares_all_that_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = interaction.audit_texts(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    last = rows.where("step = 5").groupBy("part").agg(F.max("kept").alias("kept"), F.count("*").alias("orders"))
    shares = rows.where("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("shapley").alias("all")).join(last, "part").join(docs.groupBy(F.col("lang").alias("part")).count(), "part").collect()
    assert shares and all(r.orders == 120 and r["all"] == 120 * (r["count"] - r.kept) for r in shares)


def test_one_text_in_a_third_of_the_rows(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit("en").alias("lang"))
    cells = interaction.cells(hot, awkward.labels(spark, ((0, 1, 0), (3, 1, 1))), F.col("lang"))
    assert {tuple(r) for r in cells.collect()} == {("en", 1, 2001, 1, 0), ("en", 17, 999, 1, 1)}


def test_awkward_tables(spark):
    docs = awkward.documents(spark)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    labels = [(5, 1, 0), (6, 1, 0), (8, 0, 1), (8, 0, 1), (None, 1, None), (13, 1, 0)]
    assert got(docs, awkward.labels(spark)) == brute(rows, labels)
    assert got(docs, awkward.labels(spark).limit(0)) == brute(rows, [])
    assert interaction.audit_texts(docs.limit(0), awkward.labels(spark)).count() == 0


def test_other_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 1, 1), ("p", 3, 1, 0, 0), ("q", 1, 4, 0, 0)], "part string, mask int, docs long, good long, toxic long")
    rows = {(r.part, r.filter_order, r.step): tuple(r[c] for c in interaction.COUNTS) for r in interaction.audit(cells, "xy").collect()}
    assert rows[("p", "xy", 1)] == (5, 3, 0, 0, 1, 1, 3) and rows[("p", "xy", 2)] == (5, 0, 3, 0, 0, 0, 3) and rows[("q", "yx", 2)] == (0, 4, 0, 4, 0, 0, 8)
    for names in ("", "xx", "abcdefgh"):
        with pytest.raises(ValueError):
            interaction.audit(cells, names)
