import hashlib

import public_tokenizers
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import bpe
from tests.llm import awkward

PATH = public_tokenizers.path("word_bpe_49k.json")
TRICKY = [
    "Hello WÖRLD, it's 12 o'clock!!  <|endoftext|> ok<|startoftext|>fine <|ENDOFTEXT|>", "a b c​d\x1ce\x85f", "é e ́x ẞ İ ΣΣ Å",
    "\U0001f600\U0001f468‍\U0001f469 漢字かな 123,456", "x" * 3000, "don't\tI'LL\nwe've\x0bI'm\x0che'd\rOK", "\x00\x01 \x7f", "<|end oftext|> <|endoftext|", "'s's 's", None, "",
]


def check(spark, docs, joined=None, **options):
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    text = [r.text for r in docs.orderBy("doc_id").collect()]
    rows = bpe.digests(docs, PATH, **(joined or {})).orderBy("doc_id").collect()
    back = bpe.decode(bpe.encode(docs, PATH, **options), PATH).orderBy("doc_id").collect()
    met = bpe.encode_joined(docs, PATH, **(joined or {})).orderBy("doc_id").collect()
    assert len(rows) == len(text) == len(met)
    for s, r, b, m in zip(text, rows, back, met, strict=True):
        ids = t.encode(s or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()), s
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest() and b.decoded == decoded and m.ids == ids


def test_as_the_library_does(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(spark, docs.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")))


def test_small_tables_and_chunks_do_not_change_ids(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY * 2)], "doc_id long, text string").repartition(3)
    check(spark, docs, {"buckets": 1, "most": 1}, most=2, local=3)
    check(spark, docs, {"buckets": 5, "most": 50}, most=0, local=1)


def test_each_distinct_word_is_encoded_once(spark):
    """However many chunks hold a word, one bucket does, and its task encodes it for all of them."""
    docs = spark.createDataFrame([(i, f"common word{i % 7} rare{i}") for i in range(60)], "doc_id long, text string").repartition(6)
    words = bpe._packed(docs, ["doc_id"], 4, 1).where("__bucket >= 0").select("__bucket", "__words").collect()
    of = {}
    for r in words:
        for w in zstandard.ZstdDecompressor().decompress(bytes(r["__words"])).split(b"\n"):
            of.setdefault(w, []).append(r["__bucket"])
    assert len(of) == 68 and all(len(set(b)) == 1 for b in of.values()) and len(of[b"common"]) > 1


def test_joins_give_the_same(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY * 2)], "doc_id long, text string").repartition(3).unionByName(awkward.documents(spark).where("doc_id > 9").select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"))
    plain = bpe.encode(docs, PATH).orderBy("doc_id").collect()
    by_join = bpe.encode_by_join(docs, PATH)
    assert by_join.orderBy("doc_id").collect() == plain
    assert bpe.decode_by_join(by_join, PATH).orderBy("doc_id").collect() == bpe.decode(bpe.encode(docs, PATH), PATH).orderBy("doc_id").collect()


def test_awkward_tables(spark):
    docs = awkward.documents(spark)
    assert bpe.digests(docs, PATH).count() == docs.count()
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_frequent_words_keep_the_bound(spark):
    counts = spark.createDataFrame([(bytes([97 + i]), n) for i, n in enumerate([9, 5, 5, 5, 2])], "word binary, n long")
    assert bpe.frequent(counts, 1).count() == 1 and bpe.frequent(counts, 3).count() == 1 and bpe.frequent(counts, 4).count() == 4 and bpe.frequent(counts, 0).count() == 0
