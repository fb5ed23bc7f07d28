import re
from collections import Counter

from corpusloom.llm import quality
from tests.llm import awkward


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_signals_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(awkward.documents(spark).select("doc_id", "text"))
    ratio = quality.fit(docs, awkward.labels(spark))
    for r in quality.judge(docs, ratio, extra=("text",)).collect():
        n, chars, symbols, dup, rep = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert r.kept == (not r.base_failed and r.llr >= ratio.threshold)


def test_score_is_the_normalised_log_ratio(spark):
    import math

    import xxhash

    def long(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return seed if seed < 1 << 63 else seed - (1 << 64)

    good = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"] * 3
    bad = ["buy now cheap pills click here win prize money fast today only"] * 3
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    ratio = quality.fit(docs, spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int"), buckets=64, prior=10.0, shrink=1.0)
    grams = lambda t: [long(w) % 64 for w in t.split()] + [long(a, b) % 64 for a, b in zip(t.split(), t.split()[1:])]
    raw, target = Counter(g for t in good + bad for g in grams(t)), Counter(g for t in good[:2] for g in grams(t))
    q = [(raw[b] + 0.5) / (sum(raw.values()) + 32) for b in range(64)]
    w = [math.log((target[b] + 10 * q[b]) / (sum(target.values()) + 10)) - math.log(q[b]) for b in range(64)]
    for r in quality.judge(docs, ratio, extra=("text",)).collect():
        assert abs(r.llr - sum(w[g] for g in grams(r.text)) / (len(grams(r.text)) + 1)) < 1e-6
    assert [r.kept for r in quality.judge(docs, ratio).orderBy("doc_id").collect()] == [True] * 3 + [False] * 3


def test_without_labels_or_rows(spark):
    docs, none = awkward.documents(spark), awkward.labels(spark, ()) 
    rows = quality.judge(docs, quality.fit(docs, none)).collect()
    assert len(rows) == docs.count() and all(r.kept != r.base_failed for r in rows)
    assert quality.judge(docs.limit(0), quality.fit(docs.limit(0), awkward.labels(spark))).count() == 0


def test_every_trusted_document_counts(spark):
    """All of 20,200 are trusted, so no word tells trusted from raw: not those of the 200 that a cut by hash left out."""
    ids = spark.range(20_200).toDF("doc_id")
    last = ids.orderBy(quality.F.xxhash64("doc_id").desc(), quality.F.desc("doc_id")).limit(200).withColumn("rare", quality.F.lit(True))
    docs = ids.join(last, "doc_id", "left").selectExpr("doc_id", "if(rare, 'omega psi chi phi upsilon tau sigma rho pi omicron xi', 'alpha beta gamma delta epsilon zeta eta theta iota kappa mu') as text")
    ratio = quality.fit(docs, ids.selectExpr("doc_id", "1 as quality", "0 as toxic"), prior=1.0)
    assert quality.judge(docs, ratio).where("llr < -0.1").count() == 0
