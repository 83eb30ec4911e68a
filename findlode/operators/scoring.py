"""Ranking: tf-idf, Hamming embedding, scale voting, and what combines several queries.

Every plan carries query_id, so a single query is a batch of one. Ties go to the smaller doc_id.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findlode.functions.session import checkpointed
from findlode.operators.index import norm


#: Queries whose dense lists are made at once.
DENSE_QUERIES = 1000


def top(scores: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """Each query's k best documents with their rank from 1; 0 for all."""
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), "doc_id")
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k) if k else ranked


def dense(scores: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """A score for every query and document, 0 where there is none: as large as asked for, in the shape asked for.

    Queries go to the documents in an array that is known to be short, or else in several passes.
    """
    ids = queries.select("query_id").distinct()
    parts = max(1, -(-ids.count() // DENSE_QUERIES))
    lists = [ids.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k).agg(F.sort_array(F.collect_list("query_id")).alias("ids")).first()["ids"] for k in range(parts)]
    each = [docs.select("doc_id", F.explode(F.array(*[F.lit(q).cast(ids.schema[0].dataType) for q in some])).alias("query_id")) for some in lists if some]
    if not each:
        return docs.select(F.lit(None).cast(ids.schema[0].dataType).alias("query_id"), "doc_id", F.lit(0.0).alias("score")).filter("false")
    every = functools.reduce(DataFrame.unionByName, each)
    return every.join(scores, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def tfidf(query: DataFrame, tf: DataFrame, words: DataFrame, norms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) for documents that share a word: sum of tf_q * idf**2 * tf_d over both norms.

    query: (query_id, word, tf). The idf enters twice on the query's side, and the query's norm is of tf * idf.
    """
    q = query.groupBy("query_id", "word").agg(F.sum("tf").alias("tf_q")).join(words, "word")
    q = q.withColumn("qw", F.col("tf_q") * F.col("idf"))
    q_norm = q.groupBy("query_id").agg(norm(F.sum(F.pow("qw", 2))).alias("q_l2"))
    raw = tf.join(q, "word").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("idf") * F.col("tf")).alias("raw"))
    return raw.join(norms, "doc_id").join(q_norm, "query_id").select("query_id", "doc_id", (F.col("raw") / F.col("q_l2") / F.col("l2")).alias("score"))


def signature_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_matches(query: DataFrame, postings: DataFrame, threshold: int) -> DataFrame:
    """Pairs of a query's and a document's features with the same word and at most ``threshold`` bits apart.

    query: (query_id, q_feat, word, q_sig); postings: (word, doc_id, feat_id, sig).
    """
    pairs = query.join(postings, "word").withColumn("h", signature_distance(F.col("q_sig"), F.col("sig")))
    return pairs.filter(F.col("h") <= threshold)


def gaussian(h: Column, bits: int) -> Column:
    sigma = bits / 4
    return F.exp(-(h.cast("double") * h) / (sigma * sigma))


def match_threshold(bits: int) -> int:
    return round(bits * 24 / 64)


def spatial_threshold(bits: int) -> int:
    return round(bits * 28 / 64)


def hamming(query: DataFrame, postings: DataFrame, words: DataFrame, norms: DataFrame, bits: int = 64) -> DataFrame:
    """(query_id, doc_id, score) by Hamming embedding.

    A match at distance h counts idf**2 * exp(-(h / sigma)**2), divided by the roots of how many postings the document
    and the query have under the word, matching or not. The query's normaliser is the sum, not its root, of idf**2 over
    its features; a word that no document has enters it once.
    """
    in_doc = postings.groupBy("word", "doc_id").agg(F.count("*").alias("n_d"))
    in_query = query.groupBy("query_id", "word").agg(F.count("*").alias("n_q"))
    matches = hamming_matches(query, postings, match_threshold(bits)).groupBy("query_id", "word", "doc_id").agg(F.sum(gaussian(F.col("h"), bits)).alias("w"))
    raw = matches.join(in_doc, ["word", "doc_id"]).join(in_query, ["query_id", "word"]).join(words, "word")
    raw = raw.groupBy("query_id", "doc_id").agg(F.sum(F.pow("idf", 2) * F.col("w") / F.sqrt("n_d") / F.sqrt("n_q")).alias("raw"))
    seen = postings.select("word", F.lit(True).alias("seen")).distinct()
    q_norm = in_query.join(words, "word").join(seen, "word", "left").groupBy("query_id").agg(F.sum(F.pow("idf", 2) * F.when(F.col("seen"), F.col("n_q")).otherwise(1)).alias("q_l2"))
    return raw.join(norms, "doc_id").join(q_norm, "query_id").select("query_id", "doc_id", (F.col("raw") / (F.when(F.col("q_l2") <= 1e-7, 1.0).otherwise(F.col("q_l2")) * F.col("l2"))).alias("score"))


def match_weights(query: DataFrame, postings: DataFrame, words: DataFrame, bits: int = 64) -> DataFrame:
    """Every pair under a word with its weight for spatial checks: -1 beyond the wider threshold."""
    pairs = query.join(postings, "word").withColumn("h", signature_distance(F.col("q_sig"), F.col("sig"))).join(words, "word")
    w = F.when(F.col("h") <= spatial_threshold(bits), F.pow("idf", 2) * gaussian(F.col("h"), bits)).otherwise(-1.0)
    return pairs.select("query_id", "q_feat", "doc_id", "feat_id", "word", "h", w.alias("w"))


def putative(weights: DataFrame) -> DataFrame:
    """What a document's feature may match: with several query features under its word the best of positive weight, else any not refused."""
    per = Window.partitionBy("query_id", "doc_id", "feat_id", "word")
    rows = weights.withColumn("n", F.count("*").over(per)).withColumn("best", F.max("w").over(per))
    return rows.filter(F.when(F.col("n") > 1, (F.col("best") > 0) & (F.col("w") >= F.col("best") - 1e-9)).otherwise(F.col("w") >= 0)).drop("n", "best")


def scale_votes(query: DataFrame, postings: DataFrame, words: DataFrame, norms: DataFrame, bins: int = 128) -> DataFrame:
    """(query_id, doc_id, score): the best window of a histogram of scale differences.

    query: (query_id, word, q_scale), postings: (word, doc_id, scale), scales from 0 to 255. A match votes idf**2 in the
    bin of its difference; the score is the largest sum of a sixteenth of the bins in a row, averaged over them, over
    both norms.
    """
    step, width = math.ceil(510 / bins), math.ceil(bins / 16)
    q = query.join(words, "word")
    q_l2 = q.groupBy("query_id").agg(F.sum(F.pow("idf", 2)).alias("q_l2"))
    votes = q.join(postings, "word").select("query_id", "doc_id", F.floor((F.col("q_scale") + 255 - F.col("scale")) / step).cast("int").alias("bin"), F.pow("idf", 2).alias("w"))
    filled = votes.groupBy("query_id", "doc_id", "bin").agg(F.sum("w").alias("w"))
    w = Window.partitionBy("query_id", "doc_id").orderBy("bin").rangeBetween(-(width - 1), 0)
    best = filled.withColumn("moving", F.sum("w").over(w)).groupBy("query_id", "doc_id").agg((F.max("moving") / width).alias("raw"))
    return best.join(norms, "doc_id").join(q_l2, "query_id").select("query_id", "doc_id", (F.col("raw") / (F.col("q_l2") * F.col("l2"))).alias("score"))


def soft_assignment(distances: DataFrame, sigma2: float) -> DataFrame:
    """(..., w): exp(-d2 / (2 sigma2)) of each feature's nearest words, summing up to 1 per feature."""
    rows = distances.withColumn("g", F.exp(-F.col("d2") / (2 * sigma2)))
    return rows.withColumn("w", F.col("g") / F.sum("g").over(Window.partitionBy("feat_id"))).drop("g")


def combine(scores: DataFrame, how: str, group: str = "group_id", k: int = 2) -> DataFrame:
    """Scores of several queries as one per document: their max, their sum, or the k-th largest (0 if there are fewer)."""
    if how == "max":
        value = F.max("score")
    elif how == "sum":
        value = F.sum("score")
    elif how == "kth":
        value = F.coalesce(F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)), F.lit(0.0))
    else:
        raise ValueError(f"unknown combination {how!r}")
    return scores.groupBy(group, "doc_id").agg(value.alias("score"))


def joint(query: DataFrame, groups: DataFrame) -> DataFrame:
    """The features of a group's queries as those of one query."""
    return query.join(groups, "query_id").drop("query_id").withColumnRenamed("group_id", "query_id")


def pair_votes(features: DataFrame, bits: int = 64) -> DataFrame:
    """(group_id, a, b, n): pairs of features of two queries of a group with one word, at most a quarter of the bits apart."""
    left = features.select("group_id", F.col("query_id").alias("a"), "word", F.col("q_sig").alias("sig_a"))
    right = features.select("group_id", F.col("query_id").alias("b"), "word", F.col("q_sig").alias("sig_b"))
    pairs = left.join(right, ["group_id", "word"]).filter(signature_distance(F.col("sig_a"), F.col("sig_b")) <= bits // 4)
    return pairs.groupBy("group_id", "a", "b").agg(F.count("*").alias("n"))


def without_outliers(features: DataFrame, bits: int = 64, least: int = 4, share: float = 0.25) -> DataFrame:
    """(group_id, query_id): queries that agree with others of their group.

    Two queries vote for each other with ``least`` pairs or more; a query votes for itself by its own pairs. Again and
    again queries with one vote or none go. A group that would lose more than three quarters of its queries stays whole.
    The loop runs on the votes, one row per pair of queries, and ends when nobody goes.
    """
    votes = checkpointed(pair_votes(features, bits).filter(F.col("n") >= least).select("group_id", "a", "b"))
    all_of = checkpointed(features.select("group_id", "query_id").distinct())
    left = all_of
    n = left.count()
    while True:  # a round takes a query at least
        agreed = votes.join(left.withColumnRenamed("query_id", "a"), ["group_id", "a"], "left_semi").join(left.withColumnRenamed("query_id", "b"), ["group_id", "b"], "left_semi")
        left = checkpointed(agreed.groupBy("group_id", "a").agg(F.count("*").alias("n")).filter("n > 1").select("group_id", F.col("a").alias("query_id")))
        after = left.count()
        if after == n:
            break
        n = after
    sizes = all_of.groupBy("group_id").agg(F.count("*").alias("n")).join(left.groupBy("group_id").agg(F.count("*").alias("m")), "group_id", "left")
    whole = sizes.filter(F.coalesce("m", F.lit(0)) < F.round(share * F.col("n"))).select("group_id")
    return left.join(whole, "group_id", "left_anti").unionByName(all_of.join(whole, "group_id", "left_semi"))


def distinct_objects(scores: DataFrame, objects: DataFrame, k: int = 0) -> DataFrame:
    """Each object's best document only, numbered in the order of scores. objects: (doc_id, object_id).

    The best are found by partial sums in each task; what is ranked is a row per query and object.
    """
    place = F.struct("score", (-F.col("doc_id")).alias("turn"))
    best = scores.join(objects, "doc_id").groupBy("query_id", "object_id").agg(F.max(place).alias("best"))
    rows = best.select("query_id", (-F.col("best.turn")).alias("doc_id"), "object_id", "best.score")
    return top(rows, k)


def hard_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of features under one word. Both: (feat_id, word)."""
    a = left.select(F.col("feat_id").alias("a"), "word")
    return a.join(right.select(F.col("feat_id").alias("b"), "word"), "word").select("a", "b")


def soft_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, w) of features that share words: the sum of products of their weights, each feature's weights of unit length.

    Both: (feat_id, word, w).
    """

    def unit_weights(rows: DataFrame, name: str) -> DataFrame:
        length = F.sqrt(F.sum(F.pow("w", 2)).over(Window.partitionBy("feat_id")))
        return rows.select(F.col("feat_id").alias(name), "word", (F.col("w") / F.when(length > 0, length).otherwise(1.0)).alias(f"w_{name}"))

    pairs = unit_weights(left, "a").join(unit_weights(right, "b"), "word")
    return pairs.groupBy("a", "b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("w"))
