import hashlib

import xxhash

from corpusloom.llm import ordermin
from tests.llm import awkward

MASK = (1 << 25) - 1


def signed(x):
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def h(*parts):
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else (p & ((1 << 64) - 1)).to_bytes(8, "little") if isinstance(p, int) else (p[0] & 0xFFFFFFFF).to_bytes(4, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def brute(text, k=3, m=64):
    w = (text or "").strip(" \t\n\x0b\x0c\r")
    import re

    w = re.split(r"[\x20\x09-\x0D]+", w) if w else []
    if any(len(x) > 32 for x in w):
        w = [p for x in w for p in ([x] if len(x) <= 32 else [x[i : i + 8] for i in range(0, len(x), 8)])]
    if not w:
        return set()
    grams = [(h(*w[i : i + k]), i) for i in range(len(w) - k + 1)] if len(w) >= k else [(h(" ".join(w)), 0)]
    seen, items = {}, []
    for g, i in grams:
        g >>= 25
        occ = seen[g] = seen.get(g, -1) + 1
        items.append((((g if occ == 0 else h(g, (occ,)) >> 25)), i))
    bins = {}
    for g, i in items:
        bins.setdefault((g >> 33) & (m - 1), []).append((g, i))
    out = set()
    for b, xs in bins.items():
        two = sorted(sorted(xs)[:2], key=lambda x: x[1])
        a, c = (two * 2)[:2] if len(two) == 1 else two
        out.add((b << 34) | (h(a[0], c[0]) & ((1 << 34) - 1)))
    return out


def test_signatures_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").unionByName(awkward.documents(spark).select("text"))
    for r in docs.select("text", ordermin.signature(docs.text).alias("s")).collect():
        assert set(r.s) == brute(r.text) and len(r.s) == len(set(r.s))


def test_neighbours_and_edits(spark):
    docs = awkward.documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    out = {r.doc_id: r for r in ordermin.fingerprints(docs).collect()}
    assert set(out) == set(ids)
    for at, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(at + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[i].n_chars == len(t)
        a, b, c = brute(t), brute(edited), brute(nxt)
        like = lambda x, y: len(x & y) / len(z) if (z := {v >> 34 for v in x | y}) else 1.0
        assert abs(out[i].near_edited - like(a, b)) < 1e-9 and abs(out[i].near_next - like(a, c)) < 1e-9


def test_order_matters(spark):
    a = " ".join(f"w{i}" for i in range(300))
    blocks = a.split()
    moved = " ".join(blocks[150:] + blocks[:150])
    df = spark.createDataFrame([(a, moved)], "a string, b string")
    near = df.select(ordermin.likeness(ordermin.signature(df.a), ordermin.signature(df.b))).first()[0]
    assert 0.2 < near < 0.95


def test_awkward_tables(spark):
    docs = awkward.documents(spark)
    assert ordermin.fingerprints(docs).count() == docs.count()
    assert ordermin.fingerprints(docs.limit(0)).count() == 0
    assert ordermin.fingerprints(docs.limit(1)).count() == 1
