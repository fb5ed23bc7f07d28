import hashlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from corpusloom.llm import bpe, jaccard, mixing, pii, quality
from corpusloom.llm.common import store
from tests.llm import awkward
from tests.llm.test_jaccard import brute as jaccard_brute
from tests.llm.test_pii import brute as spans_brute

DIR = "/root/testdata/sf0.001"


def test_each_stage_takes_effect(spark):
    raw = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    inputs = [raw]
    for name, f in corpus_pipeline.STAGES:
        inputs.append(store(f(spark, inputs[-1], DIR), "stage"))
        if name != "token ids":
            assert inputs[-1].schema.names == raw.schema.names and inputs[-1].dtypes == raw.dtypes
    _, good, single, clean, mixed, ids = inputs
    judged = quality.judge(raw, quality.fit(raw, labels))
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in judged.where("kept").collect())
    want = {c for _, _, c in jaccard_brute([(r.doc_id, r.text) for r in good.collect()])}
    assert {r.doc_id for r in single.collect()} == want and single.count() == len(want)
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert not spans_brute(r.text) and r.n_chars == len(r.text)
        assert spans_brute(before[r.doc_id]) or "[TERM]" in r.text or r.text == before[r.doc_id]
    copies = {r.doc_id: r.copies for r in mixing.mix(clean, labels).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in clean.collect()}
    assert ids.count() == mixed.count()
    assert all(r.ids == t.encode(text[r.doc_id], add_special_tokens=False).ids for r in ids.collect())
    assert __spark_entry__.queries()["pipeline"](spark, DIR).count() == ids.count()


def test_stages_bear_awkward_rows(spark, tmp_path):
    docs = awkward.documents(spark)
    awkward.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    kept = quality.keep(docs, quality.fit(docs, awkward.labels(spark)))
    assert kept.columns == docs.columns
    for frame in (docs, docs.limit(0)):
        for _, f in corpus_pipeline.STAGES[:-1]:
            assert f(spark, frame, str(tmp_path)).columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count() == frame.count()
    assert pii.sanitise(docs).count() == docs.count() and jaccard.keep_one(docs).count() < docs.count()


def test_token_ids_are_decoded(spark):
    docs = awkward.documents(spark).select("doc_id", "source", "text").union(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "source", "text"))
    ids = corpus_pipeline.token_ids(spark, docs, DIR)
    assert ids.columns == ["doc_id", "source", "ids", "decoded_sha256"]
    back = bpe.decode(bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")), public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, hashlib.sha256(r.decoded.encode()).hexdigest()) for r in back.collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in ids.collect()) == want and sum(want.values()) == docs.count()
