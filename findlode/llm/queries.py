"""The queries of this subpackage, and SQL for those that SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlode.llm import contamination, cotrain, langid, neardup, packing, privacy, quality, records, secrets, urlfilter
from findlode.llm.shared import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.personal_data(read(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read(spark, sf_dir, "documents"))


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(read(spark, sf_dir, "documents"))


#: A dated list for the pages, whose table has neither dates nor a list: (kind, key, category, action, entry_date).
URL_LIST = (
    ("domain", "spam-farm.example.org", "spam", "add", "2024-01-01"),
    ("domain", "spam-farm.example.org", "spam", "remove", "2024-05-01"),
    ("host", "www.spam-farm.example.org", "spam", "add", "2024-05-15"),
    ("domain", "example.net", "adult", "add", "2024-03-01"),
    ("domain", "example.net", "adult", "remove", "2024-04-01"),
    ("host", "tionsh.example.net", "malware", "add", "2024-06-01"),
    ("prefix", "blog.ththth.example.org/de", "phishing", "add", "2024-02-01"),
    ("prefix", "blog.ththth.example.org/de", "phishing", "remove", "2024-08-01"),
    ("prefix", "blog.ththth.example.org/de", "phishing", "add", "2024-10-01"),
)


def url_list(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The fixed entries, and for hosts of the pages entries whose dates follow from the host's length."""
    fixed = spark.createDataFrame(list(URL_LIST), "kind string, key string, category string, action string, entry_date string")
    host = F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    hosts = pages.select(host.alias("key")).filter("key != '' and length(key) % 4 = 0").distinct()
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).cast("string")
    first = F.length("key") * 13 % 200
    listed = hosts.select(F.lit("host").alias("kind"), "key", F.lit("listed").alias("category"), F.explode(F.array(F.struct(F.lit("add").alias("action"), day(first).alias("entry_date")), F.struct(F.lit("remove").alias("action"), day(first + 45).alias("entry_date")), F.struct(F.lit("add").alias("action"), day(first + 90).alias("entry_date")))).alias("x"))
    return fixed.unionByName(listed.select("kind", "key", "category", "x.action", "x.entry_date"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    return urlfilter.filtered(captures, url_list(spark, pages))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_personal_data, op3_quality_classifier, op4_near_duplicates, op5_packing, op6_contamination, op7_secrets, op8_records, op9_url_filter, op10_language)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_SHINGLES = """SELECT DISTINCT {id}, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS s
  FROM (SELECT {id}, {words} AS ws FROM {table}) t, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) u(i) WHERE len(ws) > 0"""


def _sql_spans(kind: str, pattern: str, group: int) -> str:
    return f"""SELECT doc_id, source, '{kind}' AS kind, unnest(list_transform(ms, lambda m, i: {{'s': list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0), 'n': length(m), 'v': vs[i]}})) AS x
  FROM (SELECT doc_id, source, string_split_regex(t, {pattern}) AS ps, regexp_extract_all(t, {pattern}) AS ms, regexp_extract_all(t, {pattern}, {group}) AS vs FROM d)"""


_ASSIGN = "'(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)'"
_URL_ENTRIES = ",\n  ".join(f"('{kind}', '{key}', '{category}', '{action}', DATE '{day}')" for kind, key, category, action, day in URL_LIST)

ORACLES = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 4], ' ')) AS n FROM d, unnest(range(1, len(ws) - 3)) u(i) WHERE len(ws) >= 5),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, unnest(range(0, 5)) v(k) WHERE n > 1 GROUP BY doc_id),
commonest AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) x GROUP BY doc_id, w) y GROUP BY doc_id),
base AS (SELECT d.doc_id, ws, ls, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(commonest.n, 0) AS top
  FROM d LEFT JOIN repeated USING (doc_id) LEFT JOIN commonest USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > 5 * len(ls)
    OR 10 * len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) < 5 * n_words
    OR 10 * len(list_filter(ws, lambda x: regexp_matches(x, '[0-9]'))) > 5 * n_words OR 10 * top > 3 * n_words) AS kept
FROM judged""",
    "op4_near_duplicates": f"""
WITH RECURSIVE sh AS ({_SHINGLES.format(id="doc_id", words=_LOWER_WORDS, table="documents")}),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, ways.y FROM reach JOIN ways ON ways.x = reach.r),
least AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least.r AS component_id, d.doc_id = least.r AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)""",
    "op6_contamination": f"""
WITH sh AS ({_SHINGLES.format(id="doc_id", words=_LOWER_WORDS, table="documents")}),
items AS ({_SHINGLES.format(id="item_id", words=_LOWER_WORDS, table="benchmark")}),
n AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS c FROM sh JOIN items USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, c::BIGINT AS shared, n::BIGINT AS item_shingles, c::DOUBLE / n AS containment FROM shared JOIN n USING (item_id) WHERE 100 * c >= 75 * n""",
    "op7_secrets": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
found AS ({_sql_spans("assign", _ASSIGN, 1)} UNION ALL {_sql_spans("access", "'AKIA[A-Z0-9]{12,}'", 0)}
  UNION ALL {_sql_spans("hex", "'[0-9a-f]{32,}'", 0)} UNION ALL {_sql_spans("owned", "'[A-Za-z0-9+/_-]{20,}'", 0)}),
spans AS (SELECT DISTINCT doc_id, source, kind, x.s::BIGINT AS s, (x.s + x.n)::BIGINT AS e, x.v AS v FROM found
  WHERE (kind != 'assign' OR length(x.v) >= 8) AND (kind != 'owned' OR (regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[a-z]') AND regexp_matches(x.v, '[A-Z]')))),
free AS (SELECT * FROM spans a WHERE kind != 'owned' OR NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = a.doc_id AND b.kind != 'owned' AND a.s < b.e AND b.s < a.e)),
owners AS (SELECT v, count(DISTINCT source) > 2 AS copied FROM free GROUP BY v),
told AS (SELECT free.*, copied, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END AS k FROM free JOIN owners USING (v)),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (kind != 'owned') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (kind != 'owned' OR NOT copied) AS spans,
    count(*) FILTER (kind != 'owned' AND NOT copied) AS n_live, count(*) FILTER (kind != 'owned' AND copied) AS n_copied, count(*) FILTER (kind = 'owned' AND NOT copied) AS n_added FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(n_added, 0) AS n_added FROM d LEFT JOIN per USING (doc_id)""",
    "op9_url_filter": rf"""
WITH c AS (SELECT page_id, DATE '2024-01-01' + (page_id % 366)::INTEGER AS day, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x != '') AS parts FROM pages),
fixed(kind, key, category, action, day) AS (VALUES
  {_URL_ENTRIES}),
hosts AS (SELECT DISTINCT host AS key, length(host) * 13 % 200 AS n FROM c WHERE length(host) % 4 = 0),
entries AS (SELECT * FROM fixed UNION ALL SELECT 'host', key, 'listed', unnest(['add', 'remove', 'add']), unnest([DATE '2024-01-01' + n::INTEGER, DATE '2024-01-01' + (n + 45)::INTEGER, DATE '2024-01-01' + (n + 90)::INTEGER]) FROM hosts),
daily AS (SELECT kind, key, day, max((action, category)) AS last FROM (SELECT DISTINCT * FROM entries) x GROUP BY kind, key, day),
steps AS (SELECT kind, key, last[1] AS action, last[2] AS category, day AS since, lead(day) OVER (PARTITION BY kind, key ORDER BY day) AS until FROM daily),
ks AS (SELECT page_id, day, 'host' AS kind, host AS key, 500 AS weight FROM c WHERE host IS NOT NULL
  UNION ALL SELECT page_id, day, 'domain', array_to_string(string_split(host, '.')[i:], '.'), len(string_split(host, '.')) - i FROM c, unnest(range(1, len(string_split(host, '.')) + 1)) u(i)
  UNION ALL SELECT page_id, day, 'prefix', host || '/' || lower(array_to_string(parts[1:i], '/')), i + 1000 FROM c, unnest(range(1, len(parts) + 1)) u(i)),
hits AS (SELECT page_id, weight, ks.kind, ks.key, category, since FROM ks JOIN steps ON ks.kind = steps.kind AND ks.key = steps.key AND action = 'add' AND day >= since AND (until IS NULL OR day < until)),
best AS (SELECT page_id, count(*) AS n, max((weight, kind, key, category, since)) AS b FROM hits GROUP BY page_id)
SELECT c.page_id, host, coalesce(n, 0)::BIGINT AS n_active, b IS NOT NULL AS blocked, CASE WHEN b IS NULL THEN '' ELSE b[2] || ':' || b[3] END AS entry, b[4] AS category, b[5]::VARCHAR AS since FROM c LEFT JOIN best USING (page_id)""",
}
