import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import langid
from tests.llm import awkward

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def real(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    return docs, langid.fit(docs)


def test_held_out_texts_get_their_language(spark, real):
    docs, model = real
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and model.families == ("germanic", "romance") and model.pairs == ((0, 1), (2, 3))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert len(unseen) > 200 and sum(r.lang == r.lang_pred for r in unseen) >= 0.99 * len(unseen)
    assert all(0 < r.score <= 1 for r in rows)


def test_a_lower_score_is_less_sure(spark, real):
    _, model = real
    mixed = spark.createDataFrame([(1, "the of and is that with was " * 30), (2, "the of and der die und das nicht " * 30)], "doc_id long, text string")
    sure, torn = (r.score for r in langid.identify(mixed, model).orderBy("doc_id").collect())
    assert sure > 0.9 > torn


def test_held_out_rows_teach_nothing(spark, real):
    docs, model = real
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    other = other.withColumn("text", F.when(langid.held_out(F.col("doc_id")), F.lit("other words")).otherwise(F.col("text"))).repartition(5)
    again = langid.fit(other.withColumn("source", F.lit("s")))
    assert again.languages == model.languages and np.array_equal(again.weights, model.weights) and np.array_equal(again.bias, model.bias)


def test_the_sample_is_bounded(spark):
    words = {"en": "the house", "fr": "la maison"}
    rows = [(i, f"{words[c]} {i}", c) for i, c in enumerate(["en"] * 900 + ["fr"] * 20)] + [(i, "the same text", "en") for i in range(2000, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(r.lang for r in langid.sample(docs, 100).collect())
    assert 90 <= got["en"] <= 160 and got["fr"] == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(900, 920))
    model = langid.fit(docs, 40)
    assert Counter(r.lang_pred for r in langid.identify(docs, model).collect()) == {"en": 1900, "fr": 20}


def test_features_count_every_gram():
    texts = ["", "Ab, ab!", "É 12 é", "x" * 3000, "word " * 999]
    got = langid.features(pa.array(texts), block=64)
    for row, text in zip(got, texts, strict=True):
        plain = b" " + re.sub(r"[^a-zé]+", " ", text.lower()).encode() + b" "
        want = np.zeros(langid.DIM)
        for n in langid.ORDERS:
            for i in range(len(plain) - n + 1):
                want[langid._buckets(np.frombuffer(plain[i : i + n], np.uint8), n)[0]] += 1
        assert np.allclose(row, np.sqrt(want / want.sum()), atol=1e-6) and abs((row * row).sum() - 1) < 1e-4


def test_machine_is_the_best_of_its_kind():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) + 0.3 * rng.normal(size=200) > 0.4, 1, -1)
    w, b = langid.linear_machine(x, y, cost=1.0, rounds=2000)
    share = np.where(y > 0, 200 / (2 * (y > 0).sum()), 200 / (2 * (y < 0).sum()))

    def loss(v):
        return v @ v / 2 + (share * np.maximum(1 - y * (x @ v[:-1] + v[-1]), 0) ** 2).sum()

    best = np.append(w, b)
    assert all(loss(best) <= loss(best + d) + 1e-6 for d in rng.normal(scale=0.01, size=(200, 6)))


def test_votes_within_the_family():
    model = langid.Model(("a", "b"), ("p", "q", "r", "s"), (0, 0, 0, 1), ((0, 1), (0, 2), (1, 2)), np.zeros((5, 1), np.float32), np.zeros(5, np.float32))
    cases = {(1, -1, 1, 1, 1): "p", (1, -1, -1, 1, 1): "q", (1, -1, -1, -1, -1): "r", (-1, 1, 9, 9, 9): "s", (1, -1, 3, -1, 1): "p", (1, -1, 1, -3, 1): "r"}
    for margins, want in cases.items():
        best, score = langid.decide(langid.Model(model.families, model.languages, model.of, model.pairs, model.weights, np.array(margins, np.float32)), np.zeros((1, 1), np.float32))
        assert model.languages[best[0]] == want and 0 <= score[0] <= 1


def test_families():
    assert [langid.family_of(c) for c in ("en", "de-AT", "pt_BR", "tlh")] == ["germanic", "germanic", "romance", "=tlh"]


def test_awkward_tables(spark, real):
    docs = awkward.documents(spark)
    rows = langid.identify(docs, real[1]).collect()
    assert len(rows) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        letter = any(c.isalpha() for c in text[r.doc_id] or "")
        assert (r.lang_pred == "und" and r.score == 0) == (not letter) and (r.doc_id is not None or not r.held_out)
    assert langid.identify(docs.limit(0), real[1]).count() == 0
    none = langid.fit(docs.limit(0))
    assert none.languages == () and {(r.lang_pred, r.score) for r in langid.identify(docs, none).collect()} == {("und", 0.0)}
    one = langid.fit(docs)
    assert one.languages == ("en",) and {r.lang_pred for r in langid.identify(docs, one).collect()} == {"en", "und"}
    null = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.fit(null).languages == ()
