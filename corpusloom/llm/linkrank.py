"""URL filter: rules by host and path, then trust and distrust propagated over the host link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, offer, small, store

#: (verdict, rule): host and path prefix; the longest rule that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(at: Column, rule_host: str) -> Column:
    return (at == rule_host) | at.endswith("." + rule_host)


def rule_of(at: Column, where: Column, rules=RULES) -> tuple[Column, Column]:
    """Columns with the longest rule that fits and with its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rest = text.partition("/")
        fits = _fits(at, rule_host) & where.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _seeds(hosts: DataFrame, rules) -> DataFrame:
    """Trusted hosts: the most specific rule for the host allows. Blocked: it blocks the whole host."""
    kind = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1].partition("/")[0])):
        rule_host, _, rest = text.partition("/")
        if said == "allow" or not rest:
            kind = F.when(_fits(F.col("host"), rule_host), F.lit("trust" if said == "allow" else "distrust")).otherwise(kind)
    found = hosts.select("host", kind.alias("kind")).where("kind is not null")
    total = found.groupBy("kind").agg(F.count("*").alias("n"))
    return found.join(F.broadcast(total), "kind").select("kind", "host", (1 / F.col("n")).alias("seed"))


#: Where a link leads: an absolute or scheme-relative reference names a host, any other stays on the page's own.
HREF = "(?i)href\\s*=\\s*[\"']?([^\"'\\s>]+)"
TARGET = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, pre-aggregated before the shuffle.

    References are resolved against the page: ``scheme://host`` and ``//host`` lead to that host, whatever stands in
    paths and queries; all others lead to the page's own host and make no edge. Null html has no links; a page whose
    url is null or has no ``://`` has no host and links nowhere; repeated rows count as often as they stand there.
    """
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), 1)
    out = pages.select(host(F.col("url")).alias("src"), F.explode(links).alias("u"))
    to = ascii_lower(F.regexp_extract(F.replace("u", F.lit("&amp;"), F.lit("&")), TARGET, 1))
    return out.select("src", to.alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(pages: DataFrame, rules=RULES, damping: float = 0.85, iterations: int = 20, cut_every: int = 5, links_a_part: int = 100_000) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank, each adding up to 1 where it has a seed.

    Trust starts at the trusted seeds and follows links; distrust starts at the blocked seeds and follows links
    backwards. What hosts without links to follow hold goes back to the seeds: as that only scales the scores of a kind,
    they are scaled once, at the end. Each round is one equi-join and one pre-aggregated sum over hosts, both kinds
    together; the edges are dealt by their start once and kept so (executors that are lost build theirs again from a
    written table), and lineage is cut by a written table every ``cut_every`` rounds. A host with more links to follow than
    ``links_a_part`` (a popular host, backwards) lies in as many parts as that asks for, by the links' ends, and its score
    alone is sent to each of them; so no task holds all links of a hub. Hosts that no seed reaches are
    absent; without seeds or links the table is empty or holds the seeds alone.
    """
    edges = store(host_edges(pages), "host_edges")
    hosts = pages.select(host(F.col("url")).alias("host")).distinct().union(edges.select("dst")).distinct()
    forward = edges.selectExpr("'trust' as kind", "src as frm", "dst as to", "n")
    both = forward.union(edges.selectExpr("'distrust'", "dst", "src", "n"))
    out = store(both.groupBy("kind", "frm").agg(F.sum("n").alias("total"), F.ceil(F.count("*") / links_a_part).cast("int").alias("parts")), "host_out")
    dealt = F.pmod(F.xxhash64("to"), F.col("parts")).cast("int").alias("part")
    moves = store(both.join(out, ["kind", "frm"]).select("kind", "frm", dealt, "to", (F.col("n") / F.col("total")).alias("w")), "host_moves")
    moves = moves.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "frm", "part").persist()
    hubs = offer(store(out.where("parts > 1").select("kind", F.col("frm").alias("host"), "parts"), "host_hubs"))
    seeds = store(_seeds(hosts, rules), "host_seeds")
    start = seeds.selectExpr("kind", "host", f"seed * {1 - damping} as score")
    state = seeds.selectExpr("kind", "host", "seed as score")
    for i in range(1, iterations + 1):
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
        sent = moves.join(state.join(hubs, ["kind", "host"], "left").select("kind", F.col("host").alias("frm"), "score", parts), ["kind", "frm", "part"])
        sent = sent.selectExpr("kind", "to as host", f"score * w * {damping} as score")
        state = start.unionByName(sent).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if i % cut_every == 0 or i == iterations:
            state = store(state, f"host_state_{i}")
    moves.unpersist()
    whole = state.groupBy("kind").agg(F.sum("score").alias("whole"))  # two rows
    state = state.join(F.broadcast(whole), "kind").selectExpr("kind", "host", "score / whole as score")
    pick = lambda k: F.round(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)), 12).alias(k)
    return state.groupBy("host").agg(pick("trust"), pick("distrust"))


def judge_urls(pages: DataFrame, rules=RULES, margin: float = 1.0, damping: float = 0.85, iterations: int = 20, broadcast_hosts: int = 100_000) -> DataFrame:
    """page_id, host, path, rule, verdict, by: every page judged by its rule, else by its host's link neighbourhood.

    Where no rule fits, a host is blocked if its distrust is positive and above ``margin`` times its trust, else it is
    allowed; so are hosts that no link or seed reaches and urls that are null or have no ``://``. Repeated rows keep
    their verdicts; an empty table gives none. The host table is broadcast only when counted to be at most
    ``broadcast_hosts`` rows; beyond that the join shuffles and skewed hosts are split at run time.
    """
    scores = host_scores(pages, rules, damping, iterations)
    bad = store(scores.where(f"distrust > 0 and distrust > {margin} * trust").select("host", F.lit(True).alias("bad")), "bad_hosts")
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("*", rule.alias("rule"), verdict.alias("ruled"))
    joined = parsed.join(F.broadcast(bad) if small(bad, broadcast_hosts) else bad, "host", "left")
    return joined.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("bad"), F.lit("block")), F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), F.lit("rule")).otherwise(F.lit("links")).alias("judged_by"),
    )
