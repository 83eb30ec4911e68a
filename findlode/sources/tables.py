"""File lists, configurations, metadata tables, and the forms in which results leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlode.operators.graph import SIZE_EDGES


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, filename): a line's number among those that aren't blank is its file's id.

    The list is read as one text, in order; it names files and is small beside them.
    """
    rows = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "").alias("names"))
    return rows.select(F.posexplode("names").alias("file_id", "filename")).select(F.col("file_id").cast("bigint").alias("file_id"), "filename")


def configuration(text: str) -> dict[str, str]:
    """``key=value`` lines; comments and other lines are left out, a later line wins."""
    return dict(line.split("=", 1) for line in text.splitlines() if "=" in line and not line.startswith("#"))


def configuration_text(values: dict[str, str]) -> str:
    return "".join(f"{k}={values[k]}\n" for k in sorted(values))


def file_stats(docs: DataFrame) -> DataFrame:
    """(line): source, target, old size and new size of every document, comma-separated."""
    return docs.select(F.concat_ws(",", "filename", "filename", "width", "height", "new_width", "new_height").alias("line"))


def point(table: DataFrame, key: str, value: int) -> DataFrame:
    """One row by its id, as JSON."""
    return table.filter(F.col(key) == value).limit(1).select(F.to_json(F.struct(*table.columns)).alias("json"))


def results_json(ranked: DataFrame, files: DataFrame) -> DataFrame:
    """(query_id, json): a query's results in order, as one JSON list."""
    rows = ranked.join(files.select(F.col("file_id").alias("doc_id"), "filename"), "doc_id")
    one = F.struct("rank", F.col("doc_id").alias("file_id"), "filename", "score")
    return rows.groupBy("query_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["file_id"].alias("file_id"), x["filename"].alias("filename"), x["score"].alias("score")))).alias("json"))


def copied(table: DataFrame, name: str) -> None:
    """A table's rows under another name."""
    table.write.mode("overwrite").saveAsTable(name)


def exported_csv(sets: DataFrame, path: str) -> None:
    """Sets with their files as CSV with a header."""
    sets.write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)


def exported_json(sets: DataFrame, path: str, edges: tuple[int, ...] = SIZE_EDGES) -> None:
    """Sets as JSON, a folder per range of sizes."""
    bucket = None
    for lo, hi in zip(edges, edges[1:], strict=False):
        inside = (F.col("set_size") >= lo) & (F.col("set_size") < hi)
        bucket = F.when(inside, F.lit(lo)) if bucket is None else bucket.when(inside, F.lit(lo))
    sets.withColumn("bucket", bucket).filter("bucket is not null").write.mode("overwrite").partitionBy("bucket").json(path)
