"""The queries of the corpus operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lm, mixing, neardup, pii, quality, secretscan, suffixdedup, tokens, urls
from .common import table, tokenizer_path

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query(
    "op10_decontamination",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query(
    "op4_source_mix",
    r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
e AS (SELECT *, CASE WHEN size > 0 THEN floor(log2(size::DOUBLE) * 8 + 1e-9)::INT ELSE -1 END AS cls FROM d),
src AS (SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY source),
w AS (SELECT source, z, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w FROM src),
c0 AS (SELECT *, (SELECT sum(z) FROM w)::BIGINT AS total FROM w),
level AS (SELECT max(lv) AS lv FROM (
  SELECT (a.total - 3 * coalesce((SELECT sum(z) FROM c0 b WHERE 3 * b.z * a.w < 3 * a.z * b.w), 0))::DOUBLE / (SELECT sum(w) FROM c0 b WHERE 3 * b.z * a.w >= 3 * a.z * b.w)::DOUBLE AS lv,
    3 * a.z::DOUBLE / a.w AS bound FROM c0 a) WHERE lv < bound),
t AS (SELECT source, z, w, total, 3 * z::DOUBLE / w <= (SELECT coalesce(lv, 1e300) FROM level) AS capped FROM c0),
tt AS (SELECT source, z, CASE WHEN capped THEN (3 * z)::DOUBLE ELSE ((total - (SELECT coalesce(sum(3 * z), 0) FROM t WHERE capped)::BIGINT) * w)::DOUBLE / (SELECT sum(w) FROM t WHERE NOT capped)::DOUBLE END AS target FROM t),
blocks AS (SELECT source, cls, ceil(count(*) / 1000.0)::BIGINT AS b FROM e GROUP BY ALL),
r AS (SELECT e.doc_id, e.source, e.size, row_number() OVER (PARTITION BY e.source ORDER BY e.cls, (e.doc_id % 2147483648 * 2654435761 % 4294967296) % b, e.size, e.doc_id) AS rnk
  FROM e JOIN blocks ON e.source IS NOT DISTINCT FROM blocks.source AND e.cls = blocks.cls),
f AS (SELECT r.*, z, target, CASE WHEN z > 0 THEN target / z::DOUBLE ELSE 0 END AS f,
  ('0x' || substr(md5('7:' || coalesce('=' || r.source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM r JOIN tt ON r.source IS NOT DISTINCT FROM tt.source)
SELECT doc_id, size, z AS source_size, target, (size * least(3, floor(rnk::DOUBLE * f + u) - floor((rnk - 1)::DOUBLE * f + u)))::BIGINT AS taken FROM f""",
)
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.plan(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op2_token_ids")
def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digest(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = quality.judged(quality.stats(docs), quality.learned_rules(docs, table(spark, sf_dir, "labels")))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query(
    "op6_url_reputation",
    r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
n AS (SELECT DISTINCT host, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS parts FROM p),
n2 AS (SELECT host, parts, array_to_string(parts[-2:], '.') AS two, array_to_string(parts[-2:], '.') IN ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'co.za', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'gov.uk', 'net.au', 'org.au', 'org.uk') AS deep FROM n),
names AS (SELECT host, CASE WHEN deep THEN two ELSE parts[-1] END AS suffix, CASE WHEN deep THEN array_to_string(parts[-3:], '.') ELSE two END AS domain FROM n2),
marks AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS good FROM p JOIN marks USING (page_id) JOIN names USING (host) GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM h) AS m0 FROM h GROUP BY suffix),
ks AS (SELECT coalesce(round(CASE WHEN o > 0 AND f > 0 THEN least(greatest(f / o - 1, 2), 1000) ELSE 1000 END, 6), 1000) AS k FROM (SELECT sum(n * (good / n - m0) ** 2 - m0 * (1 - m0)) AS o, sum(m0 * (1 - m0) * (n - 1)) AS f FROM s0)),
s AS (SELECT suffix, (good + k * m0) / (n + k) AS m, k FROM s0, ks),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good, any_value(m) AS m0 FROM h JOIN s USING (suffix) GROUP BY domain, suffix),
kd AS (SELECT coalesce(round(CASE WHEN o > 0 AND f > 0 THEN least(greatest(f / o - 1, 2), 1000) ELSE 1000 END, 6), 1000) AS k FROM (SELECT sum(n * (good / n - m0) ** 2 - m0 * (1 - m0)) AS o, sum(m0 * (1 - m0) * (n - 1)) AS f FROM d0)),
d AS (SELECT domain, (good + k * m0) / (n + k) AS m, k FROM d0, kd),
h0 AS (SELECT host, n, good, m AS m0 FROM h JOIN d USING (domain)),
kh AS (SELECT coalesce(round(CASE WHEN o > 0 AND f > 0 THEN least(greatest(f / o - 1, 2), 1000) ELSE 1000 END, 6), 1000) AS k FROM (SELECT sum(n * (good / n - m0) ** 2 - m0 * (1 - m0)) AS o, sum(m0 * (1 - m0) * (n - 1)) AS f FROM h0)),
hh AS (SELECT host, (good + k * m0) / (n + k) AS m, n + k AS w FROM h0, kh),
known AS (SELECT names.host, coalesce(hh.m, d.m, s.m, 1.0) AS mean, coalesce(hh.w, d.k, s.k, 2.0) AS w FROM names LEFT JOIN hh USING (host) LEFT JOIN d USING (domain) LEFT JOIN s USING (suffix)),
ruled AS (SELECT p.*, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN mean + 1.645 * sqrt(mean * (1 - mean) / (w + 1)) < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN known USING (host)""",
)
def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = urls.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return d.select("page_id", "host", "path", "rule", "verdict")


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secretscan.scan(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")


@query(
    "op8_near_duplicates",
    r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT w.b, r.c FROM r JOIN both_ways w ON w.a = r.v WHERE r.c < w.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c)::BIGINT AS component_id, d.doc_id = min(r.c) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.v = d.doc_id GROUP BY d.doc_id, n.n""",
)
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("class_id")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffixdedup.without_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["e"] - s["a"])
    return d.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_personal_data")
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.find(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op7_context_mixing")
def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))
