import re
from collections import Counter, defaultdict

from corpusloom.llm import linkrank

RULES = linkrank.RULES


def parts(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[2]), m[3]) if m else ("", "")


def ruled(host, path):
    best = (None, None)
    for verdict, rule in sorted(RULES, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = (rule, verdict)
    return best


def brute_scores(rows, iterations=20, d=0.85):
    edges, hosts = Counter(), set()
    for _, url, html in rows:
        src = parts(url)[0]
        hosts.add(src)
        for u in re.findall(r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)", html or ""):
            m = re.match("(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", u.replace("&amp;", "&"))
            dst = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
            if src and dst and src != dst:
                edges[src, dst] += 1
                hosts.add(dst)
    kind = {}
    for h in hosts:
        for verdict, rule in sorted(RULES, key=lambda r: len(r[1].partition("/")[0])):
            rh, _, rest = rule.partition("/")
            if (h == rh or h.endswith("." + rh)) and (verdict == "allow" or not rest):
                kind[h] = "trust" if verdict == "allow" else "distrust"
    out = {}
    for k in ("trust", "distrust"):
        seeds = [h for h in hosts if kind.get(h) == k]
        moves = defaultdict(Counter)
        for (a, b), n in edges.items():
            a, b = (a, b) if k == "trust" else (b, a)
            moves[a][b] += n
        seed = {h: 1 / len(seeds) for h in seeds}
        score = dict(seed)
        for _ in range(iterations):
            new = {h: (1 - d) * s for h, s in seed.items()}
            for a, bs in moves.items():
                for b, n in bs.items():
                    if a in score:
                        new[b] = new.get(b, 0) + d * score[a] * n / sum(bs.values())
            score = new
        out[k] = {h: s / sum(score.values()) for h, s in score.items()}
    return out


def expect(rows):
    scores = brute_scores(rows)
    out = []
    for page, url, _ in rows:
        h, p = parts(url)
        rule, verdict = ruled(h, p)
        bad = round(scores["distrust"].get(h, 0), 12)
        out.append((page, h, p, rule, verdict or ("block" if bad > 0 and bad > round(scores["trust"].get(h, 0), 12) else "allow")))
    return sorted(out, key=repr)


def judged(pages):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in linkrank.judge_urls(pages).collect()), key=repr)


a = lambda *urls: "".join(f'<a href="{u}">x</a>' for u in urls)
ROWS = [
    (1, "http://good.example.net/en/1", a("https://friend.com/a", "http://other.io/")), (2, "https://friend.com/b?x=1#y", a("http://third.com/")), (3, "http://third.com/", ""), (4, "http://spam.net/x", a("http://friend.com/")),
    (5, "http://farm.info/p", a("http://spam.net/", "http://spam.net/2", "http://third.com")), (6, "http://feeder.biz", a("http://farm.info/p")), (7, None, None), (8, "no scheme", a("http://spam.net/")), (9, "HTTP://EXAMPLE.ORG/fr/1", a("http://x.com")),
    (10, "http://spam.net", ""), (11, "http://a.example.com/de/x", ""), (12, "http://x.com/q", ""), (1, "http://good.example.net/en/1", ""), (None, "http://notnet/x://y/z", "<a href='http://spam.net'>"), (13, "a://b://c/d", ""), (14, "http://good.example.net/de/", None),
]


def test_small_graph(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    got = judged(pages)
    assert got == expect(ROWS)
    verdicts = {r[1]: r[4] for r in got if r[3] is None}
    assert verdicts["farm.info"] == "block" == verdicts["feeder.biz"] and verdicts["friend.com"] == "allow" == verdicts["x.com"]


def test_links_are_resolved(spark):
    html = a("/go?u=http://evil.net/y", "//CDN.io/z", "rel/x", "https://far.org?q=1&amp;r=//no.net", "#top", "mailto:x@y.z", "http://h.com:80/", "://odd.com/") + "<A HREF=//bare.io>"
    pages = spark.createDataFrame([(1, "http://here.com/a/b", html), (1, "http://here.com/a/b", html), (2, "http://ruled.net/x", None), (3, None, html)], "page_id long, url string, html string")
    assert sorted(map(tuple, linkrank.host_edges(pages).collect())) == [("here.com", d, 2) for d in ("bare.io", "cdn.io", "far.org", "h.com:80")]
    assert {(r.page_id, r.verdict) for r in linkrank.judge_urls(pages).collect()} == {(1, "allow"), (2, "block"), (3, "allow")}


def test_scores_add_up(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    total = linkrank.host_scores(pages).groupBy().sum("trust", "distrust").first()
    assert abs(total[0] - 1) < 1e-9 and abs(total[1] - 1) < 1e-9


def test_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert judged(pages) == expect([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert judged(pages.limit(0)) == []


def test_shuffled_join_gives_the_same(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    wide = linkrank.judge_urls(pages, broadcast_hosts=0)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in wide.collect()), key=repr) == judged(pages)


def test_a_hub_lies_in_many_parts(spark):
    """Every second host links to one popular host and it links back to some; parts of two links give the same scores."""
    rows = ROWS + [(100 + i, f"http://site{i}.com/", a("http://popular.com/", "http://spam.net/x" if i % 3 else f"http://site{i + 1}.com/")) for i in range(40)]
    rows += [(200, "http://popular.com/", a(*(f"http://site{i}.com/" for i in range(0, 40, 2)), "http://good.example.net/en/1"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = brute_scores(rows)
    for most in (2, 7, 100_000):
        got = {r.host: (r.trust, r.distrust) for r in linkrank.host_scores(pages, links_a_part=most).collect()}
        assert all(abs(got.get(h, (0, 0))[k] - s) < 1e-9 for k, x in enumerate(("trust", "distrust")) for h, s in want[x].items())
    assert judged(pages) == expect(rows)
