"""Streams: queries that arrive over time against a standing index, and activity counted in windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from findlode.functions.text import tokens
from findlode.operators import scoring


def query_words(texts: DataFrame) -> DataFrame:
    """(query_id, word) of arriving texts (query_id, text)."""
    return texts.select("query_id", F.explode(tokens(F.col("text"))).alias("word")).filter("word != ''")


def answered(arriving: DataFrame, tf: DataFrame, words: DataFrame, norms: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Ranks every micro-batch of arriving queries (query_id, text) against the index and hands the first k to ``sink``.

    The index is a static table: each batch is one batch search, so its ranking is that of the same queries asked at
    once. ``sink`` gets the batch's number and must overwrite by it, which makes a batch that runs again harmless.
    """

    def run(batch: DataFrame, number: int) -> None:
        q = query_words(batch).groupBy("query_id", "word").agg(F.count("*").cast("double").alias("tf"))
        sink(scoring.top(scoring.tfidf(q, tf, words, norms), k), number)

    return arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, users, total) per window; on a stream, events later than ``late`` are left out.

    Distinct users are exact over sets of a window's users; on a stream of very many use an approximate count.
    """
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.size(F.collect_set("user_id")).alias("users"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "users", "total")
