"""Descriptors: normalisation, distances, nearest words, residuals, medians and signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def root_normalised(values: Column) -> Column:
    """Each value over the sum (1 if that is nearly 0), then its root; below 0 counts as 0."""
    own = F.transform(values, lambda x: x.cast("double"))
    whole = total(own)
    scale = F.when(whole < 1e-6, 1.0).otherwise(whole)
    return F.transform(own, lambda x: F.sqrt(F.greatest(x / scale, F.lit(0.0))))


def unit(values: Column) -> Column:
    own = F.transform(values, lambda x: x.cast("double"))
    size = F.sqrt(total(F.transform(own, lambda x: x * x)))
    return F.transform(own, lambda x: x / F.when(size < 1e-12, 1.0).otherwise(size))


def first_dimensions(values: Column, n: int) -> Column:
    return F.slice(values, 1, n)


#: Centroids, and query vectors, that are taken to the tasks at once.
BLOCK = 50_000
#: Rows and queries of one matrix of distances.
TILE = 1024
#: Bits of a signature at most.
SIGNATURE_BITS = 64


def nearest_words(features: DataFrame, centroids: DataFrame, k: int = 1) -> DataFrame:
    """(feat_id, word, d2, place): each feature's k nearest centroids, exactly.

    features: (feat_id, vec); centroids: (word, vec). A vocabulary of up to ``BLOCK`` words is taken to the tasks once and
    every batch is one matrix product; a larger one goes in blocks.
    """
    rows = centroids.orderBy("word").limit(BLOCK + 1).collect()
    if len(rows) > BLOCK:
        return nearest_words_in_blocks(features, centroids, k)
    words = np.array([r["word"] for r in rows], np.int64)
    matrix = np.array([r["vec"] for r in rows], np.float64)
    shared = features.sparkSession.sparkContext.broadcast((words, matrix, (matrix * matrix).sum(axis=1)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words, own, squares = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                if not len(part):
                    continue
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                rough = squares[None, :] - 2 * x @ own.T
                m = min(k, len(own_words))
                near = np.argpartition(rough, m - 1, axis=1)[:, : min(len(own_words), m + 4)] if m < len(own_words) else np.tile(np.arange(m), (len(x), 1))
                d2 = ((x[:, None, :] - own[near]) ** 2).sum(axis=2)
                turn = np.lexsort((own_words[near], d2), axis=1)[:, :m]
                at = np.take_along_axis(near, turn, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(part)), m))), pa.array(own_words[at].ravel()), pa.array(np.take_along_axis(d2, turn, axis=1).ravel()), pa.array(np.tile(np.arange(1, m + 1), len(part)))], names=["feat_id", "word", "d2", "place"])

    return features.select("feat_id", "vec").mapInArrow(search, "feat_id bigint, word bigint, d2 double, place bigint")


def nearest_words_in_blocks(features: DataFrame, centroids: DataFrame, k: int = 1, block: int = BLOCK // 2) -> DataFrame:
    """As ``nearest_words``, with the vocabulary in blocks: the best of each block's best."""
    n = max(1, -(-centroids.count() // block))
    best = None
    for i in range(n):
        some = nearest_words(features, centroids.filter(F.pmod(F.xxhash64("word"), F.lit(n)) == i), k)
        best = some if best is None else best.unionByName(some)
    w = Window.partitionBy("feat_id").orderBy("d2", "word")
    return best.withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= k)


def _query_blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, words, vectors) of the queries, ``block`` or a little more at a time. queries: (feat_id, word, vec)."""
    n = max(1, -(-queries.count() // block))
    for k in range(n):
        some = queries if n == 1 else queries.filter(F.pmod(F.xxhash64("feat_id"), F.lit(n)) == k)
        rows = some.select("feat_id", "word", "vec").orderBy("feat_id").collect()
        if rows:
            yield np.array([r[0] for r in rows], np.int64), np.array([r[1] if r[1] is not None else -1 for r in rows], np.int64), np.array([r[2] for r in rows], np.float64)


def _tiles(batches: Iterator[pa.RecordBatch], words: np.ndarray, vectors: np.ndarray, apart: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(some queries, ids of some rows, squared distances between them); infinite within a word if ``apart``."""
    squares = (vectors * vectors).sum(axis=1)
    for batch in batches:
        for lo in range(0, len(batch), TILE):
            part = batch.slice(lo, TILE)
            ids, own = part.column(0).to_numpy(zero_copy_only=False), part.column(1).fill_null(-2).to_numpy(zero_copy_only=False)
            x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
            size = (x * x).sum(axis=1)
            for at in range(0, len(words), TILE):
                some = slice(at, at + TILE)
                d2 = np.maximum(squares[some, None] - 2 * vectors[some] @ x.T + size, 0.0)
                if apart:
                    d2[words[some, None] == own] = np.inf
                yield some, ids, d2


def _sides(rows: DataFrame, apart: bool) -> DataFrame:
    word = F.col("word").cast("bigint") if apart else F.lit(0).cast("bigint")
    return rows.select(F.col("feat_id").cast("bigint").alias("feat_id"), word.alias("word"), "vec")


def nearest_rows(queries: DataFrame, rows: DataFrame, k: int, apart: bool = False, block: int = BLOCK) -> DataFrame:
    """(a, b, d2, place): the k rows nearest to each query, ties to the smaller id; with ``apart`` of other words only.

    Queries, which are the smaller side, go to the tasks in blocks; the rows stay where they are. A task reports its own k
    for each query, and the best of these are the answer.
    """
    spark, best = rows.sparkSession, None
    for found in _query_blocks(_sides(queries, apart), block):
        shared = spark.sparkContext.broadcast(found)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            names, words, vectors = shared.value
            near, which = np.full((len(names), k), np.inf), np.full((len(names), k), np.iinfo(np.int64).max)
            for some, ids, d2 in _tiles(batches, words, vectors, apart):
                at = np.flatnonzero((d2 <= near[some, -1:]).any(axis=1)) + some.start
                if len(at):
                    every = np.concatenate([near[at], d2[at - some.start]], axis=1)
                    owner = np.concatenate([which[at], np.broadcast_to(ids, (len(at), len(ids)))], axis=1)
                    turn = np.lexsort((owner, every), axis=1)[:, :k]
                    near[at], which[at] = np.take_along_axis(every, turn, axis=1), np.take_along_axis(owner, turn, axis=1)
            a, place = np.nonzero(np.isfinite(near))
            yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(which[a, place]), pa.array(near[a, place])], names=["a", "b", "d2"])

        part = _sides(rows, apart).mapInArrow(search, "a bigint, b bigint, d2 double")
        best = part if best is None else best.unionByName(part)
    if best is None:
        best = spark.createDataFrame([], "a bigint, b bigint, d2 double")
    place = F.row_number().over(Window.partitionBy("a").orderBy("d2", "b")).cast("bigint")
    return best.withColumn("place", place).filter(F.col("place") <= k)


def ratio_matches(left: DataFrame, right: DataFrame, ratio2: float = 0.81, apart: bool = False) -> DataFrame:
    """(a, b, d2): each left feature's nearest right one, where it is clearly nearer than the second: d1**2 / d2**2 < ratio2."""
    near = nearest_rows(left, right, 2, apart)
    rows = near.groupBy("a").agg(F.min_by("b", "place").alias("b"), F.min("d2").alias("d2"), F.max(F.when(F.col("place") == 2, F.col("d2"))).alias("second"))
    return rows.filter((F.col("second") > 0) & (F.col("d2") / F.col("second") < ratio2)).select("a", "b", "d2")


def close_pairs(left: DataFrame, right: DataFrame, epsilon: float, block: int = BLOCK) -> DataFrame:
    """(a, b, d2) of all pairs nearer than epsilon; the right side is the stated query set and goes to the tasks in blocks."""
    out = None
    for found in _query_blocks(_sides(right, False), block):
        shared = left.sparkSession.sparkContext.broadcast(found)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            names, words, vectors = shared.value
            for some, ids, d2 in _tiles(batches, words, vectors, False):
                b, a = np.nonzero(d2 < epsilon * epsilon)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(names[some][b]), pa.array(d2[b, a])], names=["a", "b", "d2"])

        part = _sides(left, False).mapInArrow(search, "a bigint, b bigint, d2 double")
        out = part if out is None else out.unionByName(part)
    return left.sparkSession.createDataFrame([], "a bigint, b bigint, d2 double") if out is None else out


def residuals(features: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each feature's vector less its word's. features: (feat_id, word, vec, ...)."""
    return features.join(centroids.select("word", F.col("vec").alias("centre")), "word").withColumn("residual", F.zip_with("vec", "centre", lambda x, c: x.cast("double") - c)).drop("centre")


def projected(values: Column, rotation: list[list[float]]) -> Column:
    """A matrix times a vector."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rotation])
    return F.transform(rows, lambda row: total(F.zip_with(row, values, lambda r, v: r * v)))


def medians(features: DataFrame, column: str = "residual") -> DataFrame:
    """(word, dim, median): exact, per word and dimension."""
    return features.select("word", F.posexplode(column).alias("dim", "v")).groupBy("word", "dim").agg(F.percentile("v", 0.5).alias("median"))


def median_vectors(table: DataFrame) -> DataFrame:
    """(word, med): the medians of a word as one array."""
    ordered = F.sort_array(F.collect_list(F.struct("dim", "median")))
    return table.groupBy("word").agg(F.transform(ordered, lambda x: x["median"]).alias("med"))


def signature(values: Column, med: Column) -> Column:
    """A bit per dimension, 1 where the value is above the median; the first dimension is the highest bit.

    More than ``SIGNATURE_BITS`` dimensions are an error: they are to be projected first.
    """
    few = F.assert_true(F.coalesce(F.size(values), F.lit(0)) <= SIGNATURE_BITS, F.lit("a signature has 64 bits at most: project the vectors first"))
    return F.when(few.isNull(), _bits(values, med))


def _bits(values: Column, med: Column) -> Column:
    return F.aggregate(F.zip_with(values, med, lambda v, m: (v > m).cast("bigint")), F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def centroids_of(features: DataFrame) -> DataFrame:
    """(word, vec): the mean of a word's vectors."""
    means = features.select("word", F.posexplode("vec").alias("dim", "v")).groupBy("word", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("vec"))
