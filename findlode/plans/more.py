"""Further operators on the driver's tables: putative pairs, objects, regions of matches, samples, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlode.operators import evaluate, geometry, index, metadata, scoring
from findlode.operators import vectors as vx
from findlode.plans.meta import FILES, files
from findlode.plans.registry import query, read
from findlode.plans.shape import constant
from findlode.plans.text import POSTINGS, RANKED, STATISTICS, ITEMS, Corpus, scores_sql
from findlode.plans.vector import _nearest_sql, features


@query("SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0")
def hard_putative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs under one word; the vectors whose number divides by 100 are the queries."""
    rows = features(spark, sf_dir)
    return scoring.hard_pairs(rows.filter("feat_id % 100 = 0"), rows)


@query(f"""WITH n AS ({_nearest_sql(3)}), g AS (SELECT feat_id, word, exp(-d2 / 0.04) AS g FROM n), w AS (SELECT feat_id, word, g / sum(g) OVER (PARTITION BY feat_id) AS w FROM g),
u AS (SELECT feat_id, word, w / sqrt(sum(w * w) OVER (PARTITION BY feat_id)) AS w FROM w)
SELECT a.feat_id AS a, b.feat_id AS b, round(sum(a.w * b.w), 6) AS w FROM u a JOIN u b USING (word) WHERE a.feat_id % 100 = 0 GROUP BY a.feat_id, b.feat_id""")
def soft_putative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    near = vx.nearest_words(rows, vx.centroids_of(rows), 3).withColumn("d2", F.round("d2", 6))
    soft = scoring.soft_assignment(near, 0.02).select("feat_id", "word", "w")
    return scoring.soft_pairs(soft.filter("feat_id % 100 = 0"), soft).withColumn("w", F.round("w", 6))


@query("""WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS doc_id, l_quantity * 10 AS x, l_discount * 1000 AS y FROM lineitem), e AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1 FROM p)
SELECT doc_id, (floor((x - x0 + 0.1) / 25) * (floor((x1 - x0) / 25) + 5) + floor((y - y0 + 0.1) / 25))::BIGINT AS object_id FROM p, e""")
def objects_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on a grid of cells."""
    li = read(spark, sf_dir, "lineitem")
    return evaluate.objects_by_place(li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), (F.col("l_quantity") * 10).alias("x"), (F.col("l_discount") * 1000).alias("y")))


@query("WITH n AS (SELECT p_partkey AS doc_id, string_split(p_brand, '#')[2] AS name FROM part) SELECT doc_id, dense_rank() OVER (ORDER BY name) - 1 AS object_id FROM n WHERE name IS NOT NULL")
def objects_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a part of their name."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.translate("p_brand", "#", "_").alias("filename"))
    return evaluate.objects_by_name(parts, 1)


@query("""WITH a AS (SELECT l_orderkey * 1000000 + l_partkey AS match_key, l_orderkey AS file_id, l_quantity + 0.5 AS x, l_linenumber * 2.0 AS y, 40 + l_tax * 100 AS w, 30 + l_discount * 100 AS h FROM lineitem QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY l_linenumber, l_suppkey) = 1),
r AS (SELECT l_orderkey AS file_id, l_orderkey * 1000000 + l_partkey AS region_id, l_quantity AS x, l_linenumber * 2.0 AS y, 40 + l_tax * 100 AS w, 30 + l_discount * 100 AS h FROM lineitem WHERE l_linenumber <= 2 QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY l_linenumber, l_suppkey) = 1),
p AS (SELECT match_key, region_id, greatest(0, least(a.x + a.w, r.x + r.w) - greatest(a.x, r.x)) * greatest(0, least(a.y + a.h, r.y + r.h) - greatest(a.y, r.y)) AS i, a.w * a.h + r.w * r.h AS s FROM a JOIN r USING (file_id)),
m AS (SELECT match_key, min(region_id) AS region_id FROM p WHERE i / (s - i + 1e-5) > 0.9 GROUP BY match_key)
SELECT match_key, file_id, coalesce(region_id, (SELECT max(region_id) FROM r) + row_number() OVER (PARTITION BY region_id IS NULL ORDER BY match_key)) AS region_id, region_id IS NULL AS fresh FROM a LEFT JOIN m USING (match_key)""")
def match_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as regions: known ones by overlap, others with new ids."""
    li = read(spark, sf_dir, "lineitem")
    key = (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("key")
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("key").orderBy("l_linenumber", "l_suppkey"))
    one = lambda rows: rows.select("*", key).withColumn("place", place).filter("place = 1")
    box = [(F.col("l_linenumber") * 2.0).alias("y"), (40 + F.col("l_tax") * 100).alias("w"), (30 + F.col("l_discount") * 100).alias("h")]
    matches = one(li).select(F.col("key").alias("match_key"), F.col("l_orderkey").alias("file_id"), (F.col("l_quantity") + 0.5).alias("x"), *box)
    regions = one(li.filter("l_linenumber <= 2")).select(F.col("l_orderkey").alias("file_id"), F.col("key").alias("region_id"), F.col("l_quantity").alias("x"), *box)
    return geometry.assigned_regions(matches, regions)


@query("SELECT l_orderkey, l_linenumber, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM (SELECT l_orderkey, l_linenumber, 0.25 * (1 + l_tax) + 2 * 0.5 * -0.0625 * l_discount / 2 + 0.00390625 * (2 + l_discount) AS a, 0.25 * l_discount / 4 - 0.03125 * (2 + l_discount) / 2 AS b, 0.25 * (2 + l_discount) / 4 * 1.0 AS c FROM lineitem) t")
def ellipse_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ellipses under a lower triangular map."""
    t = constant([2.0, 0.0, 1.0, 0.5, 4.0, 2.0, 0.0, 0.0, 1.0])
    d = F.col("l_discount")
    e = geometry.moved_ellipse(1 + F.col("l_tax"), d / 2, 2 + d, t)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", e.alias("e")).select("l_orderkey", "l_linenumber", *[F.round(f"e.{c}", 6).alias(c) for c in "abc"])


@query("SELECT l_orderkey AS feat_id, count(*) AS n FROM lineitem WHERE l_orderkey // 1000 % greatest(1, -(-((-(-(SELECT max(l_orderkey) + 1 FROM lineitem) // 1000)) * 1000) // 5000)) = 0 GROUP BY l_orderkey")
def block_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling is the operator: whole blocks of 1000 at an even stride."""
    li = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "feat_id")
    n = li.agg(F.coalesce(F.max("feat_id"), F.lit(-1))).first()[0] + 1
    return index.block_sample(li, n, 5000).groupBy("feat_id").agg(F.count("*").alias("n"))


@query(f"WITH {POSTINGS}, n AS (SELECT word, count(*) AS n FROM postings GROUP BY word), v(quantile) AS (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (0.9)), l AS (SELECT list(n ORDER BY n) AS l, count(*) AS c, median(n) AS m FROM n) SELECT quantile, round(l[floor(quantile * (c - 1))::BIGINT + 1] + (quantile * (c - 1) - floor(quantile * (c - 1))) * (l[ceil(quantile * (c - 1))::BIGINT + 1] - l[floor(quantile * (c - 1))::BIGINT + 1]), 6)::DOUBLE AS n, round((l[floor(quantile * (c - 1))::BIGINT + 1] + (quantile * (c - 1) - floor(quantile * (c - 1))) * (l[ceil(quantile * (c - 1))::BIGINT + 1] - l[floor(quantile * (c - 1))::BIGINT + 1])) / m, 6) AS to_median FROM v, l")
def list_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.profile(index.text_postings(read(spark, sf_dir, "documents"))).select("quantile", F.round("n", 6).alias("n"), F.round("to_median", 6).alias("to_median"))


@query("SELECT event_type, median(value) AS median, count(*) AS n FROM events GROUP BY event_type")
def streaming_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians per group."""
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("median"), F.count("*").alias("n"))


@query(f"WITH {POSTINGS} SELECT word, doc_id, count(*)::DOUBLE AS tf FROM postings GROUP BY ALL")
def posting_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index without places collapses to counts."""
    return index.term_counts(index.text_postings(read(spark, sf_dir, "documents")))


@query(f"WITH {POSTINGS} SELECT word, doc_id, count(*) AS n FROM postings WHERE x <> 0 GROUP BY ALL")
def kept_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings that aren't marked as dropped."""
    rows = index.text_postings(read(spark, sf_dir, "documents")).withColumn("keep", F.col("x") != 0)
    return index.kept(rows).groupBy("word", "doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH {STATISTICS}, {ITEMS}, {scores_sql('SELECT query_id, word FROM items')}, {RANKED}, g AS (SELECT query_id // 5 AS group_id, doc_id, sum(score) AS score FROM ranked WHERE rank <= 100 GROUP BY 1, 2),
r AS (SELECT group_id, doc_id, row_number() OVER (PARTITION BY group_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM g), rel AS (SELECT doc_id, quality = 1 AND toxic = 0 AS pos, toxic = 1 AS ign FROM labels),
j AS (SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY rank) AS place, coalesce(pos, false) AS pos FROM r LEFT JOIN rel USING (doc_id) WHERE NOT coalesce(ign, false)),
c AS (SELECT *, sum(pos::INT) OVER (PARTITION BY group_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS found FROM j),
ap AS (SELECT group_id, coalesce(sum(found / place) FILTER (pos), 0) / (SELECT count(*) FROM rel WHERE pos) AS ap FROM c GROUP BY group_id) SELECT round(avg(ap), 6) AS map, count(*) AS n_queries FROM ap""")
def multi_query_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean average precision of queries of five parts each."""
    c = Corpus(spark, sf_dir)
    labels = read(spark, sf_dir, "labels")
    kinds = labels.select("doc_id", F.when(F.col("toxic") == 1, "ign").when(F.col("quality") == 1, "pos").alias("kind")).filter("kind is not null")
    rows = c.ranked(100)
    groups = evaluate.grouped_queries(c.items.select("query_id"))
    joined = scoring.combine(rows.join(groups, "query_id"), "sum").select(F.col("group_id").alias("query_id"), "doc_id", F.round("score", 12).alias("score"))
    return evaluate.mean_average_precision(scoring.top(joined, 0), kinds, joined.select("query_id")).withColumn("map", F.round("map", 6))


@query(f"WITH {FILES} SELECT '{{\"file_id\":' || file_id || ',\"filename\":\"' || filename || '\"}}' AS json FROM files WHERE file_id = 7")
def file_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point look-up, as JSON."""
    from findlode.sources.tables import point

    return point(files(spark, sf_dir).select("file_id", "filename"), "file_id", 7)


@query()
def shuffled_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling is the operator: files in a shuffled order until a total is reached. The order is Spark's hash."""
    rows = files(spark, sf_dir)
    total = rows.agg(F.sum("n_chars")).first()[0]
    return metadata.shuffled_until(rows.select("file_id", "n_chars"), "file_id", "n_chars", total // 4)
