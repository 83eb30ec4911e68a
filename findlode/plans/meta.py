"""Queries on metadata: ``documents`` as files, ``customer`` and ``orders`` as files and regions, ``events`` as activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlode.functions import text as fx
from findlode.operators import metadata as md
from findlode.plans.registry import query, read

FILES = """files AS (SELECT doc_id AS file_id, source || '/' || doc_id || '.' || lang AS filename, lang, source, n_chars FROM documents)"""
TOKENS = f"""{FILES}, texts AS (SELECT doc_id AS file_id, source || '/' || doc_id || '.' || lang || ' ' || lang || ' ' || coalesce(text, '') AS text FROM documents),
raw AS (SELECT file_id, string_split_regex(lower(text), '[^a-z]+') AS ws FROM texts),
tokens AS (SELECT file_id, i - 1 AS pos, ws[i] AS token FROM raw, unnest(range(1, len(ws) + 1)) u(i) WHERE ws[i] <> '')"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), name.alias("filename"), "lang", "source", "n_chars")


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text"), "file_id")
    return md.token_table(md.joined_text(rows, None, ["filename", "lang", "text"]))


@query(f"WITH {FILES} SELECT DISTINCT file_id FROM files WHERE lang = 'fr'")
def meta_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return md.search("lang=fr", f, f)


@query(f"WITH {FILES} SELECT DISTINCT file_id FROM files WHERE n_chars BETWEEN 500 AND 2000")
def meta_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return md.search("n_chars=(500,2000)", f, f)


@query(f"WITH {FILES} SELECT file_id FROM files WHERE filename ILIKE 'SRC1_/%7.EN'")
def meta_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.names_like(files(spark, sf_dir), "SRC1_/%7.EN")


@query(f"WITH {FILES} SELECT file_id FROM files WHERE regexp_full_match(filename, 'src1?[0-9]/[0-9]+3\\.(de|fr)')")
def meta_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter(fx.whole_match(F.col("filename"), r"src1?[0-9]/[0-9]+3\.(de|fr)")).select("file_id")


@query(f"WITH {TOKENS} SELECT file_id FROM tokens WHERE token IN ('the', 'version') GROUP BY file_id HAVING count(DISTINCT token) = 2")
def meta_fts_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.matching(token_table(spark, sf_dir), "the AND version")


@query(f"WITH {TOKENS} SELECT DISTINCT file_id FROM tokens WHERE token IN ('keit', 'ouch')")
def meta_fts_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.matching(token_table(spark, sf_dir), "keit OR ouch")


@query(f"WITH {TOKENS} SELECT DISTINCT file_id FROM tokens WHERE starts_with(token, 'vers')")
def meta_fts_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.matching(token_table(spark, sf_dir), "vers*")


@query(f"WITH {TOKENS} SELECT DISTINCT file_id FROM tokens WHERE token = 'version' AND file_id NOT IN (SELECT file_id FROM tokens WHERE token = 'de')")
def meta_fts_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.matching(token_table(spark, sf_dir), "version NOT de")


@query(f"WITH {TOKENS} SELECT DISTINCT a.file_id FROM tokens a JOIN tokens b ON a.file_id = b.file_id AND a.token = 'of' AND b.token = 'the' AND b.pos = a.pos + 1")
def meta_fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.matching(token_table(spark, sf_dir), '"of the"')


@query(f"WITH {TOKENS} SELECT source AS value, count(file_id) AS n FROM files WHERE file_id IN (SELECT file_id FROM tokens WHERE token = 'the') AND source IS NOT NULL GROUP BY source")
def fts_group_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.group_counts(files(spark, sf_dir), "source", None, md.matching(token_table(spark, sf_dir), "the"))


@query(f"WITH {FILES} SELECT source AS value, count(file_id) AS n FROM files WHERE source IS NOT NULL GROUP BY source ORDER BY source LIMIT 512")
def group_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.group_counts(files(spark, sf_dir), "source")


@query(f"WITH {FILES} SELECT file_id FROM files WHERE source = 'src3'")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.group_members(files(spark, sf_dir), "source", "src3")


@query(f"WITH {TOKENS} SELECT file_id FROM files WHERE lang = 'de' AND file_id IN (SELECT file_id FROM tokens WHERE token = 'the')")
def group_members_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's files that match a text query too."""
    return md.group_members(files(spark, sf_dir), "lang", "de", md.matching(token_table(spark, sf_dir), "the"))


@query("SELECT c_custkey AS file_id, concat_ws(' ', c_name, c_mktsegment, coalesce(o_orderpriority, ''), coalesce(o_orderstatus, '')) AS text FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def file_region_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files, orders as their regions: the text that full text search goes over."""
    f = read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "file_id")
    r = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "file_id")
    return md.joined_text(f, r, ["c_name", "c_mktsegment", "o_orderpriority", "o_orderstatus"])


@query(f"WITH {FILES} SELECT file_id, filename FROM files ORDER BY file_id LIMIT 20 OFFSET 40")
def filelist_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paging is the operator: the third page of the file list."""
    return md.paged(files(spark, sf_dir).select("file_id", "filename"), ["file_id"], 40, 60)


@query()
def filelist_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling is the operator: 100 files at random. The order is Spark's hash, which DuckDB doesn't have."""
    return md.sampled(files(spark, sf_dir), "file_id", 100)


@query("SELECT file_id, x, y, w, h FROM (SELECT l_orderkey AS file_id, l_quantity AS x, l_linenumber::DOUBLE AS y, l_tax * 100 AS w, l_discount * 100 AS h FROM lineitem) r WHERE file_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority ILIKE '1-%')")
def regions_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the files that a pattern finds."""
    li = read(spark, sf_dir, "lineitem")
    regions = li.select(F.col("l_orderkey").alias("file_id"), F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"), (F.col("l_tax") * 100).alias("w"), (F.col("l_discount") * 100).alias("h"))
    names = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderpriority").alias("filename"))
    return md.regions_of(regions, md.names_like(names, "1-%"))


@query("SELECT min(c_custkey) AS least, max(c_custkey) AS most, count(DISTINCT c_nationkey) AS n FROM customer")
def id_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").agg(F.min("c_custkey").alias("least"), F.max("c_custkey").alias("most"), F.countDistinct("c_nationkey").alias("n"))


@query("SELECT r_name, n_name, c_mktsegment AS value, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def nested_group_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name", F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS value, count(event_id) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def event_group_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.group_counts(read(spark, sf_dir, "events").withColumnRenamed("event_id", "file_id"), "event_type", None)


@query("""SELECT page_id, len(list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/'), lambda x: x <> ''))::INTEGER AS n_components,
len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> ''))::INTEGER AS n_params FROM pages""")
def uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.size(fx.path_parts(F.col("url"))).alias("n_components"), F.size(fx.query_parameters(F.col("url"))).alias("n_params"))


@query("SELECT p_partkey, CASE WHEN n >= 1000 AND n % 1000 = 0 THEN (n // 1000) || 'k' ELSE n::VARCHAR END AS short FROM (SELECT p_partkey, p_size * 500 AS n FROM part) t")
def short_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", fx.short_count((F.col("p_size") * 500).cast("bigint")).alias("short"))
