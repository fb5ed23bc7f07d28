"""Personal data: pattern spans, and terms that corpus co-occurrence shows to give a protected entity away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import held, let, settle, small, store

KINDS = ("email", "ip", "card", "phone", "term")
#: Linear-time forms of the four patterns: possessive runs, and no start inside a run that has been tried. Runs of
#: under 14 digits would be dropped as cards anyhow and aren't matched.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"\p{L}{4,}"
SPAN = "array<struct<start:int,end:int,s:string>>"


def running(steps: Column, block: int = 256) -> Column:
    """Running sums of an array of int, in blocks: appending to a long array would copy it each time."""
    sums = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int")), lambda b: sums(F.slice(steps, b * block + 1, F.lit(block))))
    total = lambda parts: F.zip_with(parts, F.slice(sums(F.transform(parts, lambda p: F.element_at(p, -1))), F.lit(1), F.size(parts)), lambda p, before: F.transform(F.slice(p, F.lit(2), F.size(p) - 1), lambda x: x + before))
    return F.when(F.size(steps) == 0, F.array().cast("array<int>")).otherwise(F.flatten(let(blocks, total)))


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points, as an array of (start, end, s).

    The pieces between the matches give the places: each match ends where the lengths so far add up to.
    """
    none = F.array().cast(SPAN)

    def places(m: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        steps = F.zip_with(pieces, m, lambda a, b: F.length(a) + F.length(b))
        spans = lambda e: F.zip_with(m, e, lambda s, end: F.struct((end - F.length(s)).alias("start"), end.alias("end"), s.alias("s")))
        return F.when(F.size(m) == 0, none).otherwise(let(let(steps, lambda s: running(s)), spans).cast(SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), places)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(rev: Column) -> Column:
        value = lambda i: F.substring(rev, i, F.lit(1)).cast("int") * (2 - i % 2)
        total = F.aggregate(F.sequence(F.lit(1), F.length(rev)), F.lit(0), lambda a, i: a + let(value(i), lambda v: F.when(v > 9, v - 9).otherwise(v)))
        return total % 10 == 0

    return let(F.reverse(digits), add)


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return let(F.regexp_replace(s, "[^0-9]", ""), lambda d: F.length(d).between(14, 19) & F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.regexp_replace(s, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans as an array of (start, k, end, s), ordered by start, then by kind as listed; null is empty."""
    hints = {"email": lambda t: t.contains("@"), "ip": lambda t: t.contains("."), "card": lambda t: F.lit(True), "phone": lambda t: t.contains("+")}

    def of(t: Column, k: int, kind: str) -> Column:
        some = F.when(hints[kind](t), found(t, PATTERNS[kind])).otherwise(F.array().cast(SPAN))
        item = lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), x["s"].alias("s"))
        return F.transform(F.filter(some, lambda x: _valid(kind, x["s"])), item)

    def every(t: Column) -> Column:
        return F.array_sort(F.concat(*[of(t, k, kind) for k, kind in enumerate(PATTERNS)]))

    return let(F.coalesce(text, F.lit("")), every)


def span_text(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _keys(x: Column) -> Column:
    """What a span gives away, without its spelling: the entity itself (kind and lower-case text, or kind and digits), and
    its class: the domain of an address, the first two parts of an ip, the first six digits of a card, the first four of
    a phone number."""
    digits = F.regexp_replace(x["s"], "[^0-9]", "")
    plain = F.when(x["k"] >= 2, digits).otherwise(F.lower(x["s"]))
    group = F.when(x["k"] == 0, F.regexp_extract(plain, "@(.*)$", 1)).when(x["k"] == 1, F.regexp_extract(plain, r"^[0-9]+\.[0-9]+", 0)).when(x["k"] == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    return F.array(F.concat_ws(":", x["k"].cast("string"), plain), F.concat_ws(":", F.lit("class"), x["k"].cast("string"), group))


def _terms(text: Column, spans: Column) -> Column:
    """The whole terms of a text that lie outside all spans, lower-case and with their places."""
    clear = lambda t: ~F.exists(spans, lambda o: (o["start"] < t["end"]) & (t["start"] < o["end"]))
    return F.transform(F.filter(found(text, TERM), clear), lambda t: F.struct(F.lower(t["s"]).alias("t"), t["start"].alias("start"), t["end"].alias("end")))


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), entities with their classes, and terms of the whole text; only texts with base spans."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where(F.col("text").rlike("[0-9@]")).select("*", base_spans(F.col("text")).alias("spans"))
    return rows.where(F.size("spans") > 0).select("doc_id", "h", F.array_distinct(F.flatten(F.transform("spans", _keys))).alias("entities"), _terms(F.col("text"), F.col("spans")).alias("terms"))


def counted(near: DataFrame) -> DataFrame:
    """doc_id, h, terms, es: the entities and classes of a text with their document frequency n_e; those that no other
    document holds are left out, and so are texts without others: seen once, nothing can be said of them."""
    each = near.select("doc_id", "h", F.explode("entities").alias("entity"))
    n_e = each.groupBy("entity").agg(F.count("*").alias("n_e")).where("n_e > 1")
    of = each.join(n_e, "entity").groupBy("doc_id", "h").agg(F.collect_set(F.struct("entity", "n_e")).alias("es"))
    of = of.select(F.col("doc_id").alias("__doc"), F.col("h").alias("__h"), "es")
    return near.join(of, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("h") == F.col("__h"))).select("doc_id", "h", "es", "terms")


def disclosing(docs: DataFrame, near: DataFrame, alpha: float = 0.8, support: int = 2, discount: float = 1.0) -> DataFrame:
    """(entity, term) where the term gives the entity, or a class of entities, away.

    With document frequencies n over all N documents, the share of the documents of e that hold t is estimated as
    ``(n(e,t) - discount + discount n(t) / N) / n(e)``: one meeting may be chance, so it counts as much as it would of any
    document. A term discloses e if that share over ``n(t) / N`` has a logarithm (the shrunk pointwise mutual information)
    of at least ``alpha`` times the information content ``ln(N / n(e))`` of e. So of an entity seen once nothing
    follows from how rare a word is; what gives it away shows by its class. Terms and entities have to meet in
    ``support`` different texts: copies of one text are one.

    As n(e,t) is at most n(e), no term with n(t) over ``N (n(e) / N) ** alpha`` can reach it, and none that stands beside
    personal data in fewer texts than ``support``: such terms go before pairs are made.
    """
    said = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), 0))).alias("term"))
    total = float(max(docs.count(), 1))
    top = near.agg(F.max(F.array_max(F.transform("es", lambda e: e["n_e"])))).first()[0] or 0
    at_most = lambda n_e: F.lit(total) * F.pow(n_e / F.lit(total), F.lit(alpha)) * F.lit(1 + 1e-6)
    beside = near.select("h", F.explode(F.array_distinct(F.transform("terms", lambda t: t["t"]))).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("term")
    n_t = said.join(beside, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") <= at_most(F.lit(float(top))))
    words = near.select("h", "es", F.explode(F.array_distinct(F.transform("terms", lambda t: t["t"]))).alias("term")).join(n_t, "term")
    pairs = words.select("h", "term", "n_t", F.explode("es").alias("e")).select("h", "term", "n_t", "e.*").where(F.col("n_t") <= at_most(F.col("n_e")))
    cooc = pairs.groupBy("entity", "term", "n_e", "n_t", "h").agg(F.count("*").alias("n_h")).groupBy("entity", "term", "n_e", "n_t").agg(F.sum("n_h").alias("n_et"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    met = F.greatest(F.col("n_et") - F.lit(discount), F.lit(0.0)) + F.lit(discount) * F.col("n_t") / F.lit(total)
    pmi = F.ln(met * F.lit(total) / (F.col("n_e").cast("double") * F.col("n_t")))
    information = F.ln(F.lit(total) / F.col("n_e"))
    return cooc.where((information > 0) & (F.round(pmi, 9) >= F.round(alpha * information, 9))).select("entity", "term")


def term_spans(docs: DataFrame, alpha: float = 0.8, support: int = 2, discount: float = 1.0, shuffled: bool = False) -> DataFrame:
    """doc_id, h, extra: the disclosing terms in the texts that hold what they disclose, as spans of kind term.

    Terms that disclose nothing go before a text's entities are asked for. ``shuffled`` gives each text the entities of
    another: what is found then is what chance finds.
    """
    since = held()
    found = store(mentions(docs), "pii_mentions")
    near = settle(counted(permuted(found) if shuffled else found), "pii_counted", since)
    reveals = store(disclosing(docs, near, alpha, support, discount), "pii_reveals")
    each = near.select("doc_id", "h", F.col("es.entity").alias("held"), F.explode("terms").alias("t")).select("doc_id", "h", "held", F.col("t.t").alias("term"), "t.start", "t.end")
    hit = each.join(F.broadcast(reveals) if small(reveals, 50_000) else reveals, "term").where(F.array_contains("held", F.col("entity")))
    span = F.struct("start", F.lit(4).alias("k"), "end", F.col("term").alias("s"))
    return settle(hit.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(span)).alias("extra")), "pii_extra", since)


def permuted(near: DataFrame, about: int = 1000) -> DataFrame:
    """``mentions`` with each text's entities passed on to the next one by a hash: what co-occurrence would be if nothing
    gave anything away. Texts pass theirs round in rings of about ``about``, so no task orders all."""
    rings = max(near.count() // about, 1)
    rows = near.withColumn("ring", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(rings))).withColumn("order", F.xxhash64("h", F.lit(2)))
    ring = Window.partitionBy("ring").orderBy("order", "doc_id")
    whole = Window.partitionBy("ring").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    passed = F.coalesce(F.lag("entities").over(ring), F.last("entities").over(whole))
    return rows.select("doc_id", "h", passed.alias("entities"), "terms")


def _joined(docs: DataFrame, extra: DataFrame, cols: list[str]) -> DataFrame:
    """``cols`` of every document with its base spans and all its spans; texts without base spans are never moved."""
    base = base_spans(F.col("text"))
    extra = extra.select(F.col("doc_id").alias("__doc"), F.col("h").alias("__eh"), F.col("extra").alias("__extra"))
    held = docs.where(F.size(base) > 0).select(*cols, F.xxhash64("text").alias("__h"), F.col("doc_id").alias("__id"), base.alias("__base"))
    held = held.join(extra, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__h") == F.col("__eh")), "left")
    spans = F.when(F.col("__extra").isNull(), F.col("__base")).otherwise(F.array_sort(F.concat("__base", "__extra")))
    none = F.array().cast("array<struct<start:int,k:int,end:int,s:string>>")
    plain = docs.where(F.size(base) == 0).select(*cols, none.alias("__base"), none.alias("__spans"))
    return held.select(*cols, "__base", spans.alias("__spans")).union(plain)


def find(docs: DataFrame, alpha: float = 0.8, support: int = 2) -> DataFrame:
    """doc_id, counts of the base kinds and of terms, base_sha256 and all spans, for every document.

    Null texts count as empty and have no spans. Repeated rows have equal results. Only texts with base spans cross a
    shuffle, to meet their terms; the others are scanned and never moved.
    """
    rows = _joined(docs, term_spans(docs, alpha, support), ["doc_id"])
    count = lambda k: F.size(F.filter("__spans", lambda x: x["k"] == k)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(span_text(F.col("__base")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("__spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by its kind in brackets."""
    run = "array<struct<start:int,k:int,end:int>>"
    slim = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end")))

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(last["start"].alias("start"), last["k"].alias("k"), F.greatest(last["end"], x["end"]).alias("end"))
        overlaps = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"] > x["start"], F.lit(False))
        return F.when(overlaps, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(x))).cast(run)

    def build(m: Column) -> Column:
        name = lambda k: F.element_at(F.array(*[F.lit(f"[{n.upper()}]") for n in KINDS]), k + 1)
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(m, i - 1)["end"])
        parts = F.transform(m, lambda x, i: F.concat(F.substring(text, before(i) + 1, x["start"] - before(i)), name(x["k"])))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(m, -1)["end"] + 1, F.length(text)))

    merged = F.aggregate(slim, F.array().cast(run), merge)
    return F.when(F.size(spans) == 0, text).otherwise(let(merged, build))


def sanitise(docs: DataFrame, alpha: float = 0.8, support: int = 2) -> DataFrame:
    """``docs`` with the same columns, personal data generalised to its kind in the text and n_chars brought up to date."""
    rows = _joined(docs, term_spans(docs, alpha, support), docs.columns)
    rows = rows.withColumn("text", F.when(F.col("text").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("__spans"))))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast("long"))
    return rows.select(*docs.columns)
