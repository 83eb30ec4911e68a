"""Queries on ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlode.plans.registry import query, read
from findlode.plans.text import RANKED, STATISTICS, Corpus, scores_sql
from findlode.streaming import feeds


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, count(DISTINCT user_id)::INTEGER AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity per hour; the same plan runs on a stream with a watermark."""
    return feeds.activity(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


TURNS = "turns AS (SELECT conv_id, string_split_regex(lower(coalesce(text, '')), '[^a-z]+') AS ws FROM conversations), said AS (SELECT conv_id AS query_id, ws[i] AS word FROM turns, unnest(range(1, len(ws) + 1)) u(i) WHERE ws[i] <> '')"


@query(f"WITH {STATISTICS}, {TURNS}, {scores_sql('SELECT query_id, word FROM said')}, {RANKED} SELECT query_id, doc_id, score FROM ranked WHERE rank <= 5")
def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns, joined to one query, against all documents."""
    c = Corpus(spark, sf_dir)
    said = feeds.query_words(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), "text"))
    return c.best(said, 5).select("query_id", "doc_id", "score")
