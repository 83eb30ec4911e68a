"""Ground truth of public retrieval benchmarks as tables.

queries: (query_id, query_name, filename, xl, yl, xu, yu); truth: (query_id, filename or object, kind).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlode.functions.prefix import numbered


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of text files; surrounding blanks and empty lines are gone."""
    rows = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.trim("value").alias("line"))
    return rows.filter("line != ''")


def _numbered(names: DataFrame, column: str) -> DataFrame:
    return numbered(names.select(column).distinct(), [column], "query_id")


def buildings(spark: SparkSession, folder: str, prefix: str = "oxc1_") -> tuple[DataFrame, DataFrame]:
    """A folder of NAME_query.txt (image and rectangle), NAME_good.txt and NAME_ok.txt (positives), NAME_junk.txt (ignored).

    Query images may carry a prefix, which goes; an empty prefix suits sets without.
    """
    rows = _lines(spark, folder)
    parts = rows.select(F.regexp_extract("file", r"^(.*)_(query|good|ok|junk)\.txt$", 1).alias("query_name"), F.regexp_extract("file", r"^(.*)_(query|good|ok|junk)\.txt$", 2).alias("role"), F.split("line", r"\s+").alias("w")).filter("role != ''")
    heads = parts.filter("role = 'query'")
    numbers = _numbered(heads, "query_name")
    image = F.get("w", F.lit(0))
    bare = F.when(F.startswith(image, F.lit(prefix)), F.substring(image, F.lit(len(prefix) + 1), F.length(image))).otherwise(image) if prefix else image
    queries = heads.join(numbers, "query_name").select("query_id", "query_name", F.concat(bare, F.lit(".jpg")).alias("filename"), *[F.get("w", F.lit(i + 1)).cast("double").alias(c) for i, c in enumerate(("xl", "yl", "xu", "yu"))])
    truth = parts.filter("role != 'query'").join(numbers, "query_name").select("query_id", F.concat(F.get("w", F.lit(0)), F.lit(".jpg")).alias("filename"), F.when(F.col("role") == "junk", "ign").otherwise("pos").alias("kind"))
    return queries, truth


def holidays(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One name per line; names that end in 00 are queries and ignore themselves, others are positives of their prefix."""
    rows = _lines(spark, path).select(F.split("line", r"\s+").alias("w")).select(F.explode("w").alias("filename")).filter("filename like '%.jpg'")
    rows = rows.withColumn("prefix", F.expr("substring(filename, 1, length(filename) - 6)"))
    heads = rows.filter("filename like '%00.jpg'")
    numbers = _numbered(heads, "prefix")
    queries = heads.join(numbers, "prefix").select("query_id", F.concat("prefix", F.lit("00")).alias("query_name"), "filename", *[F.lit(None).cast("double").alias(c) for c in ("xl", "yl", "xu", "yu")])
    truth = rows.join(numbers, "prefix").select("query_id", "filename", F.when(F.col("filename").endswith("00.jpg"), "ign").otherwise("pos").alias("kind"))
    return queries, truth


def landmarks(spark: SparkSession, path: str, docs: DataFrame, token: int = 7) -> DataFrame:
    """(query_id, doc_id, kind): lines of a query and its object ids; an object's documents carry its id in their name. x... is no id."""
    words = _lines(spark, path).select(F.split("line", " ").alias("w"))
    wanted = words.select(F.get("w", F.lit(0)).cast("bigint").alias("query_id"), F.explode(F.slice("w", F.lit(2), F.size("w"))).alias("name")).filter("name not like 'x%' and name != ''")
    name = F.get(F.split(F.regexp_extract("filename", r"(PCI_sp_.*)$", 1), "_"), F.lit(token))
    return wanted.select("query_id", F.col("name").cast("bigint").alias("object")).join(docs.select("doc_id", name.cast("bigint").alias("object")), "object").select("query_id", "doc_id", F.lit("pos").alias("kind")).distinct()


def panoramas(lines: list[str], per: int = 24) -> list[tuple[int, int, str]]:
    """(query_id, doc_id, kind): a line of query and count, then so many lines of panoramas; a panorama is ``per`` documents, as is a query."""
    out, words = [], " ".join(lines).split()
    at = 0
    while at + 1 < len(words):
        query, n = int(words[at]), int(words[at + 1])
        found = [int(w) for w in words[at + 2 : at + 2 + n]]
        out += [(query * per + i, p * per + j, "pos") for i in range(per) for p in found for j in range(per)]
        at += 2 + n
    return out
