"""Queries on graphs: links between documents of one length, or of one first line, and those that searches find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlode.operators import blocked, graph, index
from findlode.plans.registry import query, read
from findlode.plans.text import POSTINGS, RANKED, STATISTICS, Corpus, scores_sql

ALL = f"WITH RECURSIVE {STATISTICS}, {scores_sql('SELECT doc_id AS query_id, word FROM postings')}"
SELF = f"WITH RECURSIVE {STATISTICS}, {scores_sql('SELECT doc_id AS query_id, word FROM postings WHERE doc_id % 100 = 0')}, {RANKED}"
EDGES = """heads AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS line, n_chars FROM documents),
edges AS (SELECT doc_id AS src, min(doc_id) OVER (PARTITION BY n_chars) AS dst FROM heads UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY line) FROM heads)"""
ENDS = f"""WITH RECURSIVE {EDGES}, ways AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
reach(a, b) AS (SELECT DISTINCT src, src FROM edges UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b),
comp AS (SELECT a AS node, min(b) AS comp FROM reach GROUP BY a),
own AS (SELECT comp, count(*) AS set_size, list_sort(list(node)) AS members FROM comp GROUP BY comp HAVING count(*) >= 2),
sets AS (SELECT row_number() OVER (ORDER BY comp) - 1 AS set_id, set_size, members FROM own)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document to the first one of its length and the first one of its first line."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("line"))
    out = None
    for key in ("n_chars", "line"):
        least = docs.groupBy(key).agg(F.min("doc_id").alias("dst"))
        some = docs.join(least, docs[key].eqNullSafe(least[key])).select(F.col("doc_id").alias("src"), "dst")
        out = some if out is None else out.unionByName(some)
    return out.distinct()


@query(f"{ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM scores WHERE query_id <> doc_id) SELECT query_id AS src, doc_id AS dst, score FROM r WHERE k <= 10 AND score >= 0.05")
def image_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document to the ten others most like it."""
    docs = read(spark, sf_dir, "documents")
    rows = blocked.neighbours(blocked.text_words(docs), index.kept_statistics(docs, "idf"), index.kept_statistics(docs, "norms"), 10, 0.05)
    return graph.image_graph(rows, 10, 0.05)


@query(f"{SELF}, b AS (SELECT query_id, count(*) AS n, max(score) FILTER (rank = 2) AS second, max(score) FILTER (doc_id <> query_id) AS best FROM ranked GROUP BY query_id) SELECT query_id, greatest(n - 1, 0)::BIGINT AS result_count, coalesce(second, 0) AS max_score FROM b WHERE best IS NULL OR best < 0.5")
def non_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose number divides by 100 as a query against all; those that find nothing like them."""
    c = Corpus(spark, sf_dir)
    return graph.non_matching(c.best(c.postings.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "word"), 2), 0.5)


@query(f"{ENDS} SELECT node, comp FROM comp")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(edges(spark, sf_dir))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sets(graph.components(edges(spark, sf_dir)))


@query(f"{ENDS} SELECT set_id, set_size, array_to_string(members, ',') AS member_id_list FROM sets")
def group_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).select("set_id", "set_size", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("member_id_list"))


@query(f"{ENDS} SELECT set_size, count(*) AS n FROM sets GROUP BY set_size")
def set_size_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sizes(_sets(spark, sf_dir))


@query(f"{ENDS}, b(lo, hi) AS (VALUES (2, 3), (3, 4), (4, 5), (5, 10), (10, 20), (20, 50), (50, 100), (100, 5000)) SELECT lo::INTEGER AS bucket, count(*) AS n FROM sets JOIN b ON set_size >= lo AND set_size < hi GROUP BY lo")
def set_size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.size_buckets(_sets(spark, sf_dir))


@query(f"{ENDS} SELECT unnest(members) AS member_id, set_id FROM sets")
def set_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.inverse_sets(_sets(spark, sf_dir))


@query(f"{ENDS} SELECT set_id, set_size FROM sets WHERE list_has_any(members, (SELECT list(doc_id) FROM labels WHERE toxic = 1))")
def sets_with_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets that hold a document labelled toxic."""
    toxic = read(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("member_id"))
    return graph.sets_with(_sets(spark, sf_dir), toxic).select("set_id", "set_size")


@query(f"{ENDS}, m AS (SELECT set_id, set_size, unnest(members) AS doc_id, generate_subscripts(members, 1) AS place FROM sets) SELECT set_id, set_size, string_agg(source || '/' || doc_id || '.' || lang, ',' ORDER BY place) AS set_files FROM m JOIN documents USING (doc_id) GROUP BY set_id, set_size")
def group_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets with their file names, as they are exported."""
    from findlode.plans.meta import files

    return graph.exported(_sets(spark, sf_dir), files(spark, sf_dir))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT l_partkey % 1000 AS a, l_suppkey % 1000 AS b FROM lineitem), reach(a, b) AS (SELECT a, b FROM l WHERE a <> b UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
n AS (SELECT a AS node FROM l WHERE a <> b UNION SELECT b FROM l WHERE a <> b), s AS (SELECT x.a AS node, x.b AS other FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a)
SELECT node, least(node, coalesce(min(other), node)) AS comp FROM n LEFT JOIN s USING (node) GROUP BY node""")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers pointing to supplier numbers, both by their last three digits, as one directed graph."""
    li = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 1000).alias("src"), (F.col("l_suppkey") % 1000).alias("dst")).distinct().filter("src != dst")
    return graph.strong_components(li)


@query(f"WITH {POSTINGS} SELECT query_id FROM (SELECT DISTINCT doc_id AS query_id FROM postings) q WHERE query_id NOT IN (SELECT doc_id FROM labels)")
def unfinished_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run that is taken up again has still to do, labels standing for what is done."""
    docs = read(spark, sf_dir, "documents").filter(F.lower("text").rlike("[a-z]")).select(F.col("doc_id").alias("query_id"))
    return graph.unfinished(docs, read(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id")))
