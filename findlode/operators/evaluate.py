"""Judging rankings: average precision, its mean, and recall at ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findlode.functions.prefix import numbered


def _keys(truth: DataFrame) -> list[str]:
    return ["query_id", "doc_id"] if "query_id" in truth.columns else ["doc_id"]


def positives(truth: DataFrame, queries: DataFrame | None) -> DataFrame:
    """(query_id, n): how many positives each query has that has any."""
    wanted = truth.filter("kind = 'pos'")
    if "query_id" in truth.columns:
        return wanted.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n"))
    n = wanted.select("doc_id").distinct().count()
    return queries.select("query_id").distinct().select("query_id", F.lit(n).cast("bigint").alias("n")).filter("n > 0")


def judged(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, doc_id, place, positive): the ranking without ignored documents and later repeats, numbered anew.

    ranking: (query_id, doc_id, rank); truth: (query_id, doc_id, kind) with kind 'pos' or 'ign'. A truth without query_id
    holds for every query; what asks it then needs the queries too.
    """
    first = ranking.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    kinds = truth.groupBy(*_keys(truth)).agg(F.max(F.col("kind") == "ign").alias("ignored"), F.max(F.col("kind") == "pos").alias("positive"))
    rows = first.join(kinds, _keys(truth), "left").filter(~F.coalesce("ignored", F.lit(False)))
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    return rows.select("query_id", "doc_id", F.row_number().over(w).alias("place"), F.coalesce("positive", F.lit(False)).alias("positive"))


def average_precision(ranking: DataFrame, truth: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, ap): precision at each positive, over the number of positives; 0 where none is found."""
    rows = judged(ranking, truth)
    w = Window.partitionBy("query_id").orderBy("place")
    found = rows.withColumn("found", F.sum(F.col("positive").cast("int")).over(w)).filter("positive")
    hits = found.groupBy("query_id").agg(F.sum(F.col("found") / F.col("place")).alias("total"))
    return positives(truth, queries).join(hits, "query_id", "left").select("query_id", (F.coalesce("total", F.lit(0.0)) / F.col("n")).alias("ap"))


def mean_average_precision(ranking: DataFrame, truth: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    return average_precision(ranking, truth, queries).agg(F.avg("ap").alias("map"), F.count("*").alias("n_queries"))


def recall_at(ranking: DataFrame, truth: DataFrame, n: int, queries: DataFrame | None = None) -> DataFrame:
    """(at, recall) for 1 to n: the share of queries with a positive among the first ``at`` that aren't ignored."""
    first = judged(ranking, truth).filter("positive").groupBy("query_id").agg(F.min("place").alias("first"))
    ranks = positives(truth, queries).join(first, "query_id", "left").withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return ranks.groupBy("at").agg(F.avg(F.coalesce((F.col("first") <= F.col("at")).cast("double"), F.lit(0.0))).alias("recall"))


def grouped_queries(truth: DataFrame, per: int = 5) -> DataFrame:
    """(group_id, query_id): ``per`` queries in a row are one query of several parts."""
    return truth.select("query_id").distinct().select(F.floor(F.col("query_id") / per).cast("bigint").alias("group_id"), "query_id")


def by_name(truth: DataFrame, docs: DataFrame) -> DataFrame:
    """Ground truth by file name as ground truth by document."""
    return truth.join(docs.select("doc_id", "filename"), "filename").drop("filename")


def objects_by_name(docs: DataFrame, token: int = 7) -> DataFrame:
    """(doc_id, object_id): documents whose names share a token are one object; objects are numbered without gaps."""
    named = docs.select("doc_id", F.get(F.split("filename", "_"), F.lit(token)).alias("name")).filter("name is not null")
    numbers = numbered(named.select("name").distinct(), ["name"], "object_id")
    return named.join(numbers, "name").select("doc_id", "object_id")


def objects_by_place(places: DataFrame, cell: float = 25.0, repeat: int = 1) -> DataFrame:
    """(doc_id, object_id) by grid cell: places (doc_id, x, y). With ``repeat`` each place stands for so many documents."""
    edge = places.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"))
    stride = F.floor((F.col("x1") - F.col("x0")) / cell) + 5
    rows = places.crossJoin(F.broadcast(edge))
    number = F.floor((F.col("x") - F.col("x0") + 0.1) / cell) * stride + F.floor((F.col("y") - F.col("y0") + 0.1) / cell)
    out = rows.select("doc_id", number.cast("bigint").alias("object_id"))
    if repeat == 1:
        return out
    return out.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))).select((F.col("doc_id") * repeat + F.col("k")).alias("doc_id"), "object_id")
