"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, interaction, jaccard, langid, linkrank, mixing, ordermin, pii, quality, shards, spelling, trainorder, warc
from corpusloom.llm.common import read, scratch


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trainorder.materialise(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprints(read(spark, sf_dir, "documents"))


def op3_disclosure_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.group(read(spark, sf_dir, "documents")).drop("set_id")


def op5_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_ngram_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op7_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op8_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    kept = shards.ingest(docs, scratch(spark, "shards"), hours=0).read()  # the store is this query's own
    if kept is None:
        kept = docs.limit(0)
    return kept.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("text_bytes"), "lang", "source", "n_chars")


def op9_efraimidis_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("key")


def op10_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkrank.judge_urls(read(spark, sf_dir, "pages"))


def op11_transposition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit_texts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_family_then_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op13_symmetric_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_training_order, op2_order_minhash, op3_disclosure_sanitising, op4_ngram_jaccard, op5_word_table_bpe, op6_ngram_likelihood, op7_warc_segments, op8_size_tiered_compaction, op9_efraimidis_mixing, op10_link_trust, op11_transposition_audit, op12_family_then_language, op13_symmetric_delete)}
_MIX = """
WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, CASE q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id),
k AS (SELECT *, -ln((('0x' || substring(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, row_number() OVER r AS rn, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM s WINDOW r AS (ORDER BY cap / weight, source NULLS FIRST)),
v AS (SELECT *, (total - capped) / room AS level FROM o),
f AS (SELECT min(rn) AS rn, arg_min(level, rn) AS level FROM v WHERE cap >= level * weight),
t AS (SELECT source, source_size, CASE WHEN v.rn >= f.rn THEN least(cap, f.level * weight) ELSE cap END AS target FROM v, f),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS epochs FROM t),
p AS (SELECT k.doc_id, k.source, size, source_size, target, epochs, target - epochs * source_size AS rest, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, ((epochs + m) * size)::BIGINT AS taken, (epochs + m)::BIGINT AS copies FROM (SELECT *, CASE WHEN 2 * ahead + size <= 2 * rest AND size > 0 THEN 1 ELSE 0 END AS m FROM p)"""
_JACCARD = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = s.doc_id) AS component_id FROM s"""
_WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error FROM m"""



def _links_sql(iterations: int = 20, damping: float = 0.85) -> str:
    """The rules as CASE, and the rounds of the link scores one after another."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = lambda u: f"coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}'), '')"
    fits = lambda h: f"(host = '{h}' OR ends_with(host, '.{h}'))"
    by_length = sorted(linkrank.RULES, key=lambda r: -len(r[1]))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r.partition('/')[0])} AND starts_with(path, '/{r.partition('/')[2]}') THEN '{value(v, r)}'" for v, r in by_length) + " END"
    by_host = sorted(linkrank.RULES, key=lambda r: -len(r[1].partition("/")[0]))
    seed = "CASE " + " ".join(f"WHEN {fits(r.partition('/')[0])} THEN '{'trust' if v == 'allow' else 'distrust'}'" for v, r in by_host if v == "allow" or not r.partition("/")[2]) + " END"
    sql = f"""
WITH p AS (SELECT page_id, {host('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
u AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS u FROM p),
e AS (SELECT src, dst, count(*) AS n FROM (SELECT src, translate(regexp_extract(replace(u, '&amp;', '&'), '{linkrank.TARGET}', 1), '{upper}', '{lower}') AS dst FROM u) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
h AS (SELECT host FROM p UNION SELECT dst FROM e),
k AS (SELECT host, {seed} AS kind FROM h),
sd AS (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS seed FROM k WHERE kind IS NOT NULL),
b AS (SELECT 'trust' AS kind, src AS frm, dst AS too, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e),
mv AS (SELECT *, n / sum(n) OVER (PARTITION BY kind, frm) AS w FROM b),
s0 AS (SELECT kind, host, seed AS score FROM sd)"""
    for i in range(1, iterations + 1):
        sql += f", s{i} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (SELECT kind, host, seed * {1 - damping} AS score FROM sd UNION ALL SELECT m.kind, m.too, s.score * m.w * {damping} FROM mv m JOIN s{i - 1} s ON s.kind = m.kind AND s.host = m.frm) GROUP BY kind, host)"
    return sql + f""",
sn AS (SELECT kind, host, score / sum(score) OVER (PARTITION BY kind) AS score FROM s{iterations}),
bad AS (SELECT host FROM sn GROUP BY host HAVING round(coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0), 12) > round(coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0), 12)),
r AS (SELECT page_id, host, path, {case(lambda v, r: r)} AS rule, {case(lambda v, r: v)} AS ruled FROM p)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' END, 'allow') AS verdict, CASE WHEN rule IS NOT NULL THEN 'rule' ELSE 'links' END AS judged_by FROM r"""


_AUDIT = """
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
f AS (SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * len(regexp_extract_all(d.t, '[A-Z]')) > 10 * length(d.t))::INT + 8 * regexp_matches(d.t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > m.least, FALSE)::INT AS mask FROM d JOIN m ON m.t = d.t LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, k::INT AS step, 1 << (ascii(substring(o, k, 1)) - 65) AS bit, coalesce(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(substring(o, i, 1)) - 65))), 0)::INT AS gone FROM o, range(1, 6) r(k)),
r AS (SELECT part, o AS filter_order, step, bit, sum(CASE WHEN mask & (gone | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & gone = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN mask & gone > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN mask & gone = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & gone = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM c, s GROUP BY part, o, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r"""
#: The checksum table of CRC-32, a byte at a time, and the runs of each text counted before they are changed.
_SPELLING = """
WITH RECURSIVE step(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
b AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM r),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hx), 2), lambda i: ('0x' || substring(hx, i, 2))::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b, crc),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
k AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.key = b.key AND a.i = b.i AND a.word <> b.word UNION SELECT k.word, k.n, v.word, v.n FROM k JOIN v ON v.word = k.key UNION SELECT v.word, v.n, k.word, k.n FROM k JOIN v ON v.word = k.key),
g AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS f, max(near_n) AS f_n FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN f_n >= 10 * v.n THEN f END AS form, CASE WHEN f_n >= 10 * v.n THEN f_n END AS form_n FROM v LEFT JOIN g USING (word)),
w(word, root, d) AS (SELECT word, word, 0 FROM f UNION ALL SELECT w.word, f.form, d + 1 FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(root, d) AS root FROM w GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)"""


#: The rest have no SQL: hashes that SQL engines don't share, tokenizers, span positions, or iteration. Tests hold them
#: against brute force.
SQL: dict[str, str] = {
    "op4_ngram_jaccard": _JACCARD,
    "op7_warc_segments": _WARC,
    "op8_size_tiered_compaction": "SELECT doc_id, sha256(text) AS text_sha256, CAST(strlen(text) AS BIGINT) AS text_bytes, lang, source, n_chars FROM documents",
    "op9_efraimidis_mixing": _MIX,
    "op10_link_trust": _links_sql(),
    "op11_transposition_audit": _AUDIT,
    "op13_symmetric_delete": _SPELLING,
}
