import hashlib
import math
import re
from collections import Counter

from corpusloom.llm import pii
from pyspark.sql import functions as F
from tests.llm import awkward

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), m[0]))
    return sorted(out)


TRICKY = [
    "a@b.c+d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4", "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112 12", "+1 (555) 010-9999... +49 30 1234567", "é\U0001f600 j@k.de, 10.0.0.1\n+1-555-010-9999-1",
    "1.2.3.4@x.y.z +1.2.3.4567890", "a" * 20000 + "@b.cc", "1" * 20000, "x@" + ".a" * 9000, "x@y" + ".a" * 9000, "- 1 - 2 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "..%+a@-.-", "", None,
]


def test_base_spans_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").union(awkward.documents(spark).select("text")).union(spark.createDataFrame([(t,) for t in TRICKY], "text string"))
    for r in docs.select("text", pii.base_spans(docs.text).alias("s")).collect():
        assert [(x.start, x.k, x.end, x.s) for x in r.s] == brute(r.text), r.text


def test_masking_leaves_no_part_of_a_span(spark):
    docs = spark.createDataFrame([(t,) for t in TRICKY if t], "text string")
    for r in docs.select("text", pii.masked(docs.text, pii.base_spans(docs.text)).alias("m")).collect():
        flags = [None] * len(r.text)
        want, at = "", 0
        for s, k, e, _ in brute(r.text):
            if s >= at:
                want += r.text[at:s] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, e)
        assert r.m == want + r.text[at:] and flags


def keys_of(k, m):
    d = re.sub("[^0-9]", "", m)
    group = {0: m.lower().split("@")[-1], 1: ".".join(m.split(".")[:2]), 2: d[:6], 3: d[:4]}[k]
    return {(k, d if k >= 2 else m.lower()), ("class", k, group)}


def terms_brute(rows, alpha=0.8, support=2, discount=1.0):
    """rows: (doc_id, text); all pairs of a key (an entity or its class) and a term of its text, by the definition."""
    near, n_e, n_et, n_t, texts = [], Counter(), Counter(), Counter(), {}
    for i, t in rows:
        t = t or ""
        spans, keys, terms = brute(t), set(), []
        for w in set(re.findall(r"[^\W\d_]{4,}", t.lower())):
            n_t[w] += 1
        for _, k, _, m in spans:
            keys |= keys_of(k, m)
        if spans:
            terms = [x for x in re.finditer(r"[^\W\d_]{4,}", t) if not any(a < x.end() and x.start() < b for a, _, b, _ in spans)]
        near.append((i, keys, terms))
        n_e.update(keys)
        for p in {(e, x[0].lower()) for e in keys for x in terms}:
            n_et[p] += 1
            texts.setdefault(p, set()).add(t)
    n = len(rows)

    def discloses(e, w):
        met = max(n_et[e, w] - discount, 0) + discount * n_t[w] / n
        return len(texts[e, w]) >= support and n > n_e[e] > 1 and round(math.log(met * n / (n_e[e] * n_t[w])), 9) >= round(alpha * math.log(n / n_e[e]), 9)

    ok = {p for p in n_et if discloses(*p)}
    return {(i, x.start(), x.end()) for i, keys, terms in near for x in terms if any((e, x[0].lower()) in ok for e in keys)}


def test_disclosing_terms_match_brute_force(spark):
    import random

    rng = random.Random(3)
    common = [f"word{chr(97 + i)}" for i in range(26)]
    rows = [(i, " ".join(rng.choices(common, k=30))) for i in range(200)]
    for i in range(200, 230):
        who = "jane.doe@corp.example.org" if i % 2 else "+1 555 010 9999"
        give = "astronaut" if i % 2 else "wordb lighthouse"
        rows.append((i, f"{rng.choice(common)} the {give} {rng.choice(common)} writes from {who} and {rng.choice(common)} {i}"))
    rows += [(300, rows[201][1]), (301, None), (302, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, x.start, x.end) for r in pii.term_spans(docs, support=3).collect() for x in r.extra}
    want = terms_brute(rows, 0.8, 3)
    assert got == want and want
    words = {dict(rows)[i][s:e] for i, s, e in got}
    assert {"astronaut", "lighthouse"} <= words and "wordb" not in words
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, support=3).collect()}
    assert all("astronaut" not in (t or "") and "@" not in (t or "") for t in clean.values())
    assert all(clean[i] == t for i, t in rows[:200])


def test_entities_seen_once_have_terms_by_their_class_only(spark):
    rows = [(i, f"the letter number {'abcdefghij'[i % 10] * 5} came late from home") for i in range(400)]
    rows += [(400 + i, f"the xylograph came late {'klmnopqrst'[i % 10] * 5} from writer{i}@one.example.org") for i in range(8)]
    rows += [(420, "the theremin came from +1 555 010 9999"), (421, "the zither came late from alone@two.example.org"), (422, "the zither came late from home")]
    rows += [(423, "a harmonium for card 4111 1111 1111 1111"), (424, "a harmonium for card 4111 1111 1111 1111"), (425, "the ocarina from 10.0.7.1"), (426, "an ocarina by 10.0.9.2 and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, x.start, x.end) for r in pii.term_spans(docs).collect() for x in r.extra}
    words = {dict(rows)[i][s:e] for i, s, e in got}
    assert "xylograph" in words and "ocarina" in words and not words & {"theremin", "zither", "harmonium", "late", "came", "card"}
    assert got == terms_brute(rows)
    chance = pii.term_spans(docs, shuffled=True).agg(F.sum(F.size("extra"))).first()[0] or 0
    assert chance <= len(got)


def test_real_documents_as_brute_force(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, x.start, x.end) for r in pii.term_spans(real).collect() for x in r.extra}
    assert got == terms_brute([tuple(r) for r in real.collect()])
    assert pii.find(real).agg(F.sum("n_term")).first()[0] == len(got)


def test_planted_terms_stand_out_of_chance(spark):
    import random

    rng = random.Random(8)
    common = [f"w{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcd"]
    rows = [(i, " ".join(rng.choices(common, k=25))) for i in range(900)]
    rows += [(1000 + i, " ".join(rng.choices(common, k=12)) + f" secretproject{'abc'[i % 3]} mails p{i}@firm{'abc'[i % 3]}.example.org " + " ".join(rng.choices(common, k=12))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    count = lambda **o: Counter(x.s for r in pii.term_spans(docs, **o).collect() for x in r.extra)
    real, chance = count(), count(shuffled=True)
    assert real == {f"secretproject{c}": 20 for c in "abc"} and sum(chance.values()) < 0.05 * sum(real.values())


def test_a_long_text_of_many_known_entities(spark):
    log = " ".join(f"10.{i // 250}.{i % 250}.7 word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}x" for i in range(600))
    rows = [(1, log), (2, log + " end"), (3, "10.0.3.7 wordakx")] + [(i, "plain words here") for i in range(4, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, x.start, x.end) for r in pii.term_spans(docs).collect() for x in r.extra} == terms_brute(rows)


def test_digest_and_awkward_tables(spark):
    docs = awkward.documents(spark)
    rows = pii.find(docs).collect()
    assert len(rows) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        b = brute(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e, _ in b).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in b) for k in range(4))
    kept = pii.sanitise(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert pii.find(docs.limit(0)).count() == 0
    assert kept.where(F.col("text").contains("@")).count() == 0
