import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from corpusloom.llm import trainorder
from tests.llm import awkward

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 1000, 4097])
def test_permutation(n):
    p = trainorder.permute(np.arange(n, dtype=np.uint64), n, 5)
    assert sorted(p.tolist()) == list(range(n))
    if n > 100:
        assert p.tolist() != trainorder.permute(np.arange(n, dtype=np.uint64), n, 6).tolist() != list(range(n))


@pytest.mark.parametrize("source", ["files", "memory"])
def test_round_trip_and_resume(spark, tmp_path, source):
    docs = awkward.documents(spark)
    if source == "files":
        docs.repartition(3).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    shards = trainorder.write(docs, str(tmp_path / "out"), PATH, stride=4)
    rows = trainorder.read_back(shards, stride=4).collect()
    assert sorted(r.slot for r in rows) == list(range(docs.count()))
    enc = encoding()
    key = lambda i, t: (i if i is not None else -1, hashlib.sha256(" ".join(map(str, enc.encode_ordinary(t or ""))).encode()).hexdigest())
    assert sorted(key(r.doc_id, r.text) for r in docs.collect()) == sorted((r.doc_id if r.doc_id is not None else -1, r.tokens_sha256) for r in rows)
    first = shards.orderBy("shard").first()
    whole = list(trainorder.read_shard(first.path, first.width))
    assert [(i, d, t.tolist()) for i, d, t in trainorder.read_shard(first.path, first.width, 2)] == [(i, d, t.tolist()) for i, d, t in whole[2:]]
    again = trainorder.write(docs, str(tmp_path / "again"), PATH, stride=4).orderBy("shard").collect()
    for a, b in zip(shards.orderBy("shard").collect(), again, strict=True):
        for ext in (".bin", ".idx"):
            assert open(a.path + ext, "rb").read() == open(b.path + ext, "rb").read()


def test_empty_table(spark, tmp_path):
    docs = awkward.documents(spark).limit(0)
    assert trainorder.read_back(trainorder.write(docs, str(tmp_path / "o"), PATH)).count() == 0
