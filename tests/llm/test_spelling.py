import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb

from corpusloom.llm import queries, spelling
from tests.llm import awkward


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts_of(rows, least_chars=7, least_n=2, every=31):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_chars and c >= least_n}


def brute(n, ratio=10):
    near_of = defaultdict(list)
    for a in n:
        near_of[a] = [b for b in n if abs(len(a) - len(b)) <= 1 and near(a, b)]
    form = {}
    for w, others in near_of.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near_of[w]), n[form[w]] if form[w] else None))
    return out


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_keys_of_equal_strings_are_equal():
    index, keys = spelling.delete_keys(["aab", "ab", "b", "abb", ""])
    of = defaultdict(set)
    for i, k in zip(index, keys, strict=True):
        of[int(i)].add(int(k))
    assert [len(of[i]) for i in range(5)] == [3, 3, 2, 3, 1]
    plain = {w: int(spelling.delete_keys([w])[1][0]) for w in ("aab", "ab", "aa", "b", "a", "abb", "bb")}
    assert of[0] == {plain["aab"], plain["ab"], plain["aa"]} and of[3] == {plain["abb"], plain["bb"], plain["ab"]}
    assert of[2] == {plain["b"], next(iter(of[4]))}


def test_as_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcé", k=rng.randint(7, 9))) for _ in range(60)]
    texts = []
    for i in range(400):
        words = rng.choices(base, [2.0**-(k % 12) for k in range(60)], k=30)
        for k in rng.sample(range(30), 4):
            w, p = words[k], rng.randrange(8)
            words[k] = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abcé×") + w[p:], w[:p] + rng.choice("ABCÉ") + w[p + 1 :]])
        texts.append((None if i % 50 == 0 else i, " ".join(words)))
    texts += [texts[3], texts[3], (900, None), (901, ""), (902, "12 -- ***")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = spelling.groups(docs)
    want = brute(counts_of(texts))
    assert rows(got) == want and got.count() == len(want)
    assert sum(f is not None for _, f, *_ in want) > 20
    assert rows(spelling.groups(docs, most=7)) == want


def test_chains_reach_their_last_form(spark):
    chain = ["a" * k + "bcdefg" for k in range(1, 14)]
    n = {w: 10**k for k, w in enumerate(chain)}
    got = rows(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute(n) and {r for _, _, r, *_ in got} == {chain[-1]}


def test_ties_take_the_smallest_form(spark):
    n = {"zzzzzzz": 1, "zzzzzzé": 10, "zzzzzzx": 10, "zzzzzzy": 10, "zzzzzz": 9, "yyyyyyy": 2}
    got = rows(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute(n) and ("zzzzzzz", "zzzzzzx", "zzzzzzx", 1, 4, 10) in got


def test_many_words_round_one_deletion(spark):
    stem = "stemword"
    n = {stem[:i] + c + stem[i:]: 5 for i in range(9) for c in map(chr, [*range(97, 123), *range(0xC0, 0x100)])} | {stem: 60}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert rows(got) == brute(n)


def test_very_long_words(spark):
    rng = random.Random(1)
    long = "".join(rng.choices("abcdef", k=60_000))
    n = {long: 1, long[:500] + long[501:]: 20, "x" * 50_000: 3, "x" * 50_001: 40, long[::-1]: 2}
    got = {(len(w), f and len(f), len(r), k, m) for w, f, r, k, m, _ in rows(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))}
    assert got == {(60_000, 59_999, 59_999, 1, 1), (59_999, None, 59_999, 20, 1), (50_000, 50_001, 50_001, 3, 1), (50_001, None, 50_001, 40, 1), (60_000, None, 60_000, 2, 0)}


def test_awkward_tables(spark):
    docs = awkward.documents(spark)
    got = spelling.groups(docs)
    assert rows(got) == brute(counts_of([(r.doc_id, r.text) for r in docs.collect()]))
    assert spelling.groups(docs.limit(0)).count() == 0 and spelling.groups(docs.where("text is null")).count() == 0
    extra = spark.createDataFrame([("letters", 30, "x", 1), ("lettrs", 2, "y", 2), (None, 3, "z", 3)], "word string, n long, form string, id int").where("word is not null")
    assert rows(spelling.variants(extra)) == {("letters", None, "letters", 30, 1, None), ("lettrs", "letters", "letters", 2, 1, 30)}


def test_as_sql_on_awkward_rows(spark):
    texts = [(None, "Letters letters Lettèrs ÀÉÿabcd àéÿabcd ÀÉÿabcd"), (None, "letters " * 40), (3, None), (4, "lettrs lettrs leters leters"), (4, "lettrs lettrs leters leters")] + [(i, "wordings wordingß letterss " * 3) for i in range(5, 60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    out = con.execute(queries.SQL["op13_symmetric_delete"])
    names = [c[0] for c in out.description]
    assert {tuple(dict(zip(names, r, strict=True))[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in out.fetchall()} == rows(spelling.groups(docs)) == brute(counts_of(texts))
