"""Queries on rectangles, ellipses and transforms, taken from ``lineitem``'s numbers, and on passages as planar shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlode.functions import text as fx
from findlode.functions.session import checkpointed, if_few
from findlode.operators import blocked
from findlode.operators import geometry as geo
from findlode.plans.registry import query, read
from findlode.plans.text import Corpus

BOXES = "a AS (SELECT l_orderkey AS file_id, l_linenumber AS region_id, l_quantity AS x, l_linenumber * 2.0 AS y, 40 + l_tax * 100 AS w, 30 + l_discount * 100 AS h FROM lineitem)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a file, its lines are regions."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("region_id"), F.col("l_quantity").alias("x"), (F.col("l_linenumber") * 2.0).alias("y"), (40 + F.col("l_tax") * 100).alias("w"), (30 + F.col("l_discount") * 100).alias("h"))


@query(f"""WITH {BOXES}, b AS (SELECT file_id, region_id, x + 1 AS x, y + 1 AS y, w, h FROM a),
p AS (SELECT a.file_id, a.region_id, b.region_id AS match_id, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s FROM a JOIN b USING (file_id)),
j AS (SELECT *, i / (s - i + 1e-5) AS iou FROM p WHERE i / (s - i + 1e-5) > 0.7)
SELECT file_id, region_id, min((match_id, iou))[1] AS match_id, round(min((match_id, iou))[2], 6) AS iou FROM j GROUP BY file_id, region_id""")
def iou_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region with the first region, moved by one, that it overlaps by more than 0.7."""
    a = boxes(spark, sf_dir)
    b = a.withColumns({"x": F.col("x") + 1, "y": F.col("y") + 1})
    return geo.overlapping(a, b, 0.7).withColumn("iou", F.round("iou", 6))


T = [1.25, -0.25, 3.5, 0.125, 0.75, -2.0, 0.0, 0.0, 1.0]


def constant(t: list[float]) -> F.Column:
    return F.array(*[F.lit(x) for x in t])


@query(f"""WITH {BOXES}, c AS (SELECT *, trunc(x) AS x0, trunc(y) AS y0, trunc(x + w) AS x1, trunc(y + h) AS y1 FROM a),
m AS (SELECT file_id, region_id, 1.25 * x0 - 0.25 * y0 + 3.5 AS mx, 0.125 * x0 + 0.75 * y0 - 2.0 AS my, trunc(1.25 * x1 - 0.25 * y1 + 3.5) AS rx, trunc(0.125 * x1 + 0.75 * y1 - 2.0) AS ry FROM c)
SELECT file_id, region_id, round(mx::DOUBLE, 6) AS x, round(my::DOUBLE, 6) AS y, round((rx - mx)::DOUBLE, 6) AS w, round((ry - my)::DOUBLE, 6) AS h FROM m""")
def match_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).withColumn("m", geo.match_region(F.col("x"), F.col("y"), F.col("w"), F.col("h"), constant(T)))
    return rows.select("file_id", "region_id", *[F.round(F.col(f"m.{c}"), 6).alias(c) for c in ("x", "y", "w", "h")])


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_linenumber::DOUBLE AS y1, 1 + l_tax AS a1, l_discount / 2 AS b1, 1 + l_discount AS c1, l_quantity + 5 AS x2, l_linenumber + 7.0 AS y2, 2 + l_discount AS a2, l_tax / 2 AS b2, 2 + l_tax AS c2 FROM lineitem),
f AS (SELECT *, sqrt(c1) AS r1, sqrt(c2) AS r2, b1 / sqrt(c1) AS q1, b2 / sqrt(c2) AS q2 FROM e), g AS (SELECT *, sqrt(a1 - q1 * q1) / sqrt(a2 - q2 * q2) AS h0, r1 / r2 AS h4 FROM f), k AS (SELECT *, (q1 - q2 * h0) / r2 AS h3 FROM g)
SELECT l_orderkey, l_linenumber, round(h0, 6) AS h0, round(h3, 6) AS h3, round(h4, 6) AS h4, round(x2 - h0 * x1, 6) AS tx, round(y2 - h3 * x1 - h4 * y1, 6) AS ty FROM k""")
def affine_hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform that one pair of ellipses stands for."""
    li = read(spark, sf_dir, "lineitem")
    q, n, d, t = F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.col("l_discount"), F.col("l_tax")
    h = geo.hypothesis((q, n, 1 + t, d / 2, 1 + d), (q + 5, n + 7.0, 2 + d, t / 2, 2 + t))
    rows = li.select("l_orderkey", "l_linenumber", h.alias("h"))
    return rows.select("l_orderkey", "l_linenumber", *[F.round(F.get("h", F.lit(i)), 6).alias(c) for i, c in ((0, "h0"), (3, "h3"), (4, "h4"), (2, "tx"), (5, "ty"))])


@query("""SELECT l_orderkey, l_linenumber, round(1.25 * l_quantity - 0.25 * l_linenumber + 3.5, 6) AS x, round(0.125 * l_quantity + 0.75 * l_linenumber - 2.0, 6) AS y, round((1.25 * 0.75 + 0.25 * 0.125)::DOUBLE, 6) AS det, round(l_quantity, 6) AS back FROM lineitem""")
def homography_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transform applied, its determinant, and its inverse applied to that."""
    t = constant(T)
    there = geo.applied(t, F.col("l_quantity"), F.col("l_linenumber").cast("double"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", there.alias("p"))
    back = geo.applied(geo.inverse(t), F.col("p.x"), F.col("p.y"))["x"]
    return rows.select("l_orderkey", "l_linenumber", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), F.round(geo.determinant(t), 6).alias("det"), F.round(back, 6).alias("back"))


@query("SELECT count(*) AS n, 0::BIGINT AS n_scale, 0::BIGINT AS n_ratio, 0::BIGINT AS n_angle FROM range(256) a, range(256) b, range(254) c WHERE b.range > 0")
def ellipse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quantised ellipses with a direction come back as they were; the two ends of the angle's range are one direction."""
    grid = spark.range(0, 256 * 255 * 254, 1, 16)
    grid = grid.select((F.col("id") % 256).cast("int").alias("scale"), (F.floor(F.col("id") / 256) % 255 + 1).cast("int").alias("ratio"), (F.floor(F.col("id") / (256 * 255)) + 1).cast("int").alias("angle"))
    e = grid.withColumn("e", geo.restored_ellipse(F.col("scale"), F.col("ratio"), F.col("angle")))
    q = e.withColumn("q", geo.quantised_ellipse(F.col("e.a"), F.col("e.b"), F.col("e.c")))
    return q.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"q.{c}") != F.col(c)).alias(f"n_{c}") for c in ("scale", "ratio", "angle")])


@query("SELECT l_orderkey, l_linenumber, printf('%.4f,%.4f,%.4f,%.4f', l_quantity, l_discount, l_tax, l_extendedprice) AS region, printf('%.6f,%.6f,%.6f,%.6f,%.6f,%.6f', l_tax, l_discount, l_quantity, l_tax, l_discount, l_quantity) AS h FROM lineitem")
def region_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and transforms as the text that interfaces and tables carry."""
    t, d, q = F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fx.region_csv(q, d, t, F.col("l_extendedprice")).alias("region"), fx.transform_csv(F.array(t, d, q, t, d, q)).alias("h"))


#: First documents that are verified, as many as the engine does.
DEPTH = 200


def _passages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items' first documents, and what a common shift of each item and document says.

    A passage that a document holds word by word is the item moved along the text.
    """
    c = Corpus(spark, sf_dir)
    first = checkpointed(c.best(c.items.select("query_id", "word"), DEPTH).select("query_id", "doc_id", "score", "rank"))
    items = c.items.groupBy("query_id").agg(F.collect_list(F.struct("pos", "word")).alias("l")).select("query_id", F.col("l.word").alias("q_words"), F.col("l.pos").alias("q_places"))
    found = c.docs.join(if_few(first.select("doc_id").distinct()), "doc_id", "left_semi")
    return first, geo.verified_words(blocked.text_words(found, places=True), first.select("query_id", "doc_id").join(if_few(items), "query_id"))


@query()
def ransac_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items' first documents again, by how many of the item's words fit one shift. The search is a loop; tests recover known transforms."""
    first, checked = _passages(spark, sf_dir)
    return geo.rescored(first, checked, DEPTH).select("query_id", "doc_id", F.round("score", 6).alias("score"), "inliers")


@query()
def match_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of words that fit, for each item and document."""
    _, checked = _passages(spark, sf_dir)
    return checked.filter("inliers >= 4").select("query_id", "doc_id", F.explode("pairs").alias("p")).select("query_id", "doc_id", "p.q_feat", "p.feat_id")


@query()
def registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift between all vectors and the same vectors moved; tests recover known transforms."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("feat_id"), F.col("embedding").alias("vec"), (F.col("vec_id") % 37 * 10).cast("double").alias("x"), (F.col("vec_id") % 23 * 10).cast("double").alias("y"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("c"))
    moved = rows.withColumns({"x": F.col("x") + 12, "y": F.col("y") - 7})
    return geo.registered(rows, moved).select("inliers", F.transform("h", lambda v: F.round(v, 4)).alias("h"))
