"""Queries on ``embeddings``: a vector is a feature, its label its coarse word, five vectors in a row a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlode.operators import index, scoring, training
from findlode.operators import vectors as vx
from findlode.plans.registry import query, read

DIMENSIONS = "e AS (SELECT vec_id, label AS word, vec_id // 5 AS doc_id, i - 1 AS dim, embedding[i]::DOUBLE AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i))"
CENTRES = f"{DIMENSIONS}, c AS (SELECT word, dim, avg(v) AS v FROM e GROUP BY word, dim)"
MEDIANS = f"{DIMENSIONS}, m AS (SELECT word, dim, median(v) AS med FROM e GROUP BY word, dim)"
# Bits in two halves: a shift into the highest bit overflows in SQL.
SIGNATURES = f"""{MEDIANS}, s AS (SELECT vec_id, word, doc_id, sum(CASE WHEN dim < 32 AND v > med THEN 1::BIGINT << (31 - dim) ELSE 0 END)::BIGINT AS hi, sum(CASE WHEN dim >= 32 AND v > med THEN 1::BIGINT << (63 - dim) ELSE 0 END)::BIGINT AS lo FROM e JOIN m USING (word, dim) GROUP BY vec_id, word, doc_id)"""
PAIRS = f"""{SIGNATURES}, idf AS (SELECT word, ln((SELECT count(DISTINCT doc_id) FROM s)::DOUBLE / count(DISTINCT doc_id)) AS idf FROM s GROUP BY word),
p AS (SELECT q.doc_id AS query_id, q.vec_id AS q_feat, d.doc_id, d.vec_id AS feat_id, word, (bit_count(xor(q.hi, d.hi))::INTEGER + bit_count(xor(q.lo, d.lo))::INTEGER) AS h FROM s q JOIN s d USING (word) WHERE q.doc_id % 100 = 0)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("feat_id"), F.col("label").alias("word"), F.floor(F.col("vec_id") / 5).cast("bigint").alias("doc_id"), F.col("embedding").alias("vec"))


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with 64-bit signatures against their word's medians."""
    rows = features(spark, sf_dir)
    med = vx.median_vectors(vx.medians(rows.withColumn("residual", F.transform("vec", lambda x: x.cast("double")))))
    return rows.join(med, "word").withColumn("sig", vx.signature(F.transform("vec", lambda x: x.cast("double")), F.col("med"))).drop("med")


def queries_of(rows: DataFrame) -> DataFrame:
    """The documents whose number divides by 100 are the queries, against all."""
    return rows.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("feat_id").alias("q_feat"), "word", F.col("sig").alias("q_sig"))


def words(rows: DataFrame) -> DataFrame:
    return index.idf(index.term_counts(rows), rows)


@query(f"WITH {CENTRES} SELECT word, dim::INTEGER AS dim, round(v, 6) AS v FROM c")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vx.centroids_of(features(spark, sf_dir)).select("word", F.posexplode("vec").alias("dim", "v")).withColumn("v", F.round("v", 6))


def _nearest_sql(k: int) -> str:
    return f"WITH {CENTRES}, d AS (SELECT vec_id AS feat_id, c.word::BIGINT AS word, sum((e.v - c.v) * (e.v - c.v)) AS d2 FROM e JOIN c USING (dim) GROUP BY vec_id, c.word), r AS (SELECT *, row_number() OVER (PARTITION BY feat_id ORDER BY d2, word) AS place FROM d) SELECT feat_id, word, round(d2, 6) AS d2, place FROM r WHERE place <= {k}"


@query(_nearest_sql(1))
def knn_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    return vx.nearest_words(rows, vx.centroids_of(rows), 1).withColumn("d2", F.round("d2", 6))


@query(_nearest_sql(3))
def knn_assign3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest words, as for queries from outside."""
    rows = features(spark, sf_dir)
    return vx.nearest_words(rows, vx.centroids_of(rows), 3).withColumn("d2", F.round("d2", 6))


@query(f"WITH n AS ({_nearest_sql(3)}), g AS (SELECT *, exp(-d2 / 0.04) AS g FROM n) SELECT feat_id, word, round(g / sum(g) OVER (PARTITION BY feat_id), 6) AS w FROM g")
def soft_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    near = vx.nearest_words(rows, vx.centroids_of(rows), 3).withColumn("d2", F.round("d2", 6))
    return scoring.soft_assignment(near, 0.02).select("feat_id", "word", F.round("w", 6).alias("w"))


@query(f"WITH {DIMENSIONS}, l AS (SELECT vec_id, CASE WHEN sum(v) < 1e-6 THEN 1.0 ELSE sum(v) END AS l1 FROM e GROUP BY vec_id) SELECT vec_id AS feat_id, round(sum(sqrt(greatest(v / l1, 0))), 5) AS total, round(max(sqrt(greatest(v / l1, 0))), 5) AS most FROM e JOIN l USING (vec_id) GROUP BY vec_id")
def root_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).select("feat_id", vx.root_normalised(F.col("vec")).alias("r"))
    return rows.select("feat_id", F.round(vx.total(F.col("r")), 5).alias("total"), F.round(F.array_max("r"), 5).alias("most"))


@query(f"WITH {CENTRES} SELECT vec_id AS feat_id, round(sum((e.v - c.v) * (e.v - c.v)), 6) AS size2 FROM e JOIN c USING (word, dim) GROUP BY vec_id")
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    out = vx.residuals(rows, vx.centroids_of(rows))
    return out.select("feat_id", F.round(vx.total(F.transform("residual", lambda x: x * x)), 6).alias("size2"))


@query(f"WITH {MEDIANS} SELECT word, dim::INTEGER AS dim, round(med, 9) AS median FROM m")
def residual_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).withColumn("residual", F.transform("vec", lambda x: x.cast("double")))
    return vx.medians(rows).select("word", "dim", F.round("median", 9).alias("median"))


@query(f"WITH {SIGNATURES} SELECT vec_id AS feat_id, hi, lo FROM s")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lit((1 << 32) - 1)
    return signed(spark, sf_dir).select("feat_id", F.shiftrightunsigned("sig", 32).alias("hi"), F.col("sig").bitwiseAND(low).alias("lo"))


@query(f"WITH {PAIRS} SELECT query_id, q_feat, doc_id, feat_id, word, h FROM p WHERE h <= 24")
def hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signed(spark, sf_dir)
    return scoring.hamming_matches(queries_of(rows), rows.select("word", "doc_id", "feat_id", "sig"), scoring.match_threshold(64)).select("query_id", "q_feat", "doc_id", "feat_id", "word", "h")


HAMMING = f"""{PAIRS}, nd AS (SELECT word, doc_id, count(*) AS n_d FROM s GROUP BY ALL), nq AS (SELECT doc_id AS query_id, word, count(*) AS n_q FROM s WHERE doc_id % 100 = 0 GROUP BY ALL),
tf AS (SELECT doc_id, CASE WHEN sum(pow(n_d * idf, 2)) <= 1e-7 THEN 1.0 ELSE sqrt(sum(pow(n_d * idf, 2))) END AS l2 FROM nd JOIN idf USING (word) GROUP BY doc_id),
w AS (SELECT query_id, word, doc_id, sum(exp(-(h::DOUBLE * h) / 256.0)) AS w FROM p WHERE h <= 24 GROUP BY ALL),
raw AS (SELECT query_id, doc_id, sum(idf * idf * w / sqrt(n_d) / sqrt(n_q)) AS raw FROM w JOIN nd USING (word, doc_id) JOIN nq USING (query_id, word) JOIN idf USING (word) GROUP BY query_id, doc_id),
ql AS (SELECT query_id, sum(idf * idf * n_q) AS q_l2 FROM nq JOIN idf USING (word) GROUP BY query_id)"""


@query(f"WITH {HAMMING} SELECT query_id, doc_id, round(raw / (CASE WHEN q_l2 <= 1e-7 THEN 1.0 ELSE q_l2 END * l2), 6) AS score FROM raw JOIN ql USING (query_id) JOIN tf USING (doc_id)")
def hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signed(spark, sf_dir)
    own = words(rows)
    norms = index.tfidf_norms(index.term_counts(rows), own)
    return scoring.hamming(queries_of(rows), rows.select("word", "doc_id", "feat_id", "sig"), own, norms).withColumn("score", F.round("score", 6))


@query(f"WITH {PAIRS} SELECT query_id, q_feat, doc_id, feat_id, h, round(CASE WHEN h <= 28 THEN idf * idf * exp(-(h::DOUBLE * h) / 256.0) ELSE -1.0 END, 6) AS w FROM p JOIN idf USING (word)")
def spatial_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signed(spark, sf_dir)
    return scoring.match_weights(queries_of(rows), rows.select("word", "doc_id", "feat_id", "sig"), words(rows)).select("query_id", "q_feat", "doc_id", "feat_id", "h", F.round("w", 6).alias("w"))


@query(f"""WITH {PAIRS}, w AS (SELECT query_id, q_feat, doc_id, feat_id, word, CASE WHEN h <= 28 THEN idf * idf * exp(-(h::DOUBLE * h) / 256.0) ELSE -1.0 END AS w FROM p JOIN idf USING (word)),
b AS (SELECT *, count(*) OVER g AS n, max(w) OVER g AS best FROM w WINDOW g AS (PARTITION BY query_id, doc_id, feat_id, word))
SELECT query_id, q_feat, doc_id, feat_id FROM b WHERE CASE WHEN n > 1 THEN best > 0 AND w >= best - 1e-9 ELSE w >= 0 END""")
def putative_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signed(spark, sf_dir)
    weights = scoring.match_weights(queries_of(rows), rows.select("word", "doc_id", "feat_id", "sig"), words(rows))
    return scoring.putative(weights).select("query_id", "q_feat", "doc_id", "feat_id")


@query("""WITH d AS (SELECT a.vec_id AS a, b.vec_id AS b, (SELECT sum((x - y) * (x - y)) FROM (SELECT unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y) t) AS d2 FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.label <> b.label)
SELECT a, first(b ORDER BY d2, b) AS b, round(min(d2), 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS place FROM d) r WHERE place <= 2 GROUP BY a HAVING min(d2) / max(d2) < 0.95""")
def ratio_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose number divides by 100 against those of other labels, by a wide ratio."""
    rows = features(spark, sf_dir)
    return vx.ratio_matches(rows.filter("feat_id % 100 = 0"), rows, 0.95, apart=True).withColumn("d2", F.round("d2", 6))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round((SELECT sum((x - y) * (x - y)) FROM (SELECT unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y) t), 5) AS d2 FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0 AND d2 < 1.0""")
def epsilon_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors against those whose number divides by 100, at distances below 1."""
    rows = features(spark, sf_dir).select("feat_id", "vec")
    return vx.close_pairs(rows, rows.filter("feat_id % 100 = 0"), 1.0).withColumn("d2", F.round("d2", 5)).filter("d2 < 1.0")


@query(f"WITH n AS ({_nearest_sql(1)}), {DIMENSIONS} SELECT n.word, count(DISTINCT vec_id) AS n, round(sum(v * v), 4) AS size2 FROM n JOIN e ON n.feat_id = e.vec_id GROUP BY n.word")
def kmeans_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assignment step of k-means from the labels' means."""
    rows = features(spark, sf_dir)
    near = vx.nearest_words(rows, vx.centroids_of(rows), 1).select("feat_id", "word")
    sizes = rows.select("feat_id", vx.total(F.transform("vec", lambda x: x.cast("double") * x.cast("double"))).alias("s"))
    return near.join(sizes, "feat_id").groupBy("word").agg(F.count("*").alias("n"), F.round(F.sum("s"), 4).alias("size2"))


@query()
def kmeans_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, n, distortion) of a vocabulary of ten words after five iterations; tests hold it against numpy."""
    rows = features(spark, sf_dir).select("feat_id", "vec")
    vocabulary = training.kmeans(rows, 10, 5)
    near = vx.nearest_words(rows, vocabulary, 1)
    return near.groupBy("word").agg(F.count("*").alias("n"), F.round(F.sum("d2"), 6).alias("distortion"))


@query()
def pca_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bit, norm): the rows of a 16-bit rotation; tests hold it against numpy."""
    rows = features(spark, sf_dir)
    matrix = training.rotation(vx.residuals(rows, vx.centroids_of(rows)), 16)
    return spark.createDataFrame([(i, float(round(sum(x * x for x in row), 6))) for i, row in enumerate(matrix)], "bit int, norm double")
