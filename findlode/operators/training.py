"""Vocabularies and rotations, and the rules of thumb for their sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a sample that fits the driver.
SAMPLE = 100_000


def vocabulary_size(n_descriptors: int) -> tuple[int, int]:
    """Words and iterations for a number of training descriptors."""
    if n_descriptors >= 18_000_000:
        return 100_000, 10
    words = 1000 if n_descriptors < 100_000 else 1000 + n_descriptors // 3000
    return words, 5 if words < 10_000 else 20


def _assigned(shared):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sums and counts by word: what is shuffled is a vocabulary per task, however many features there are."""
        matrix = shared.value
        sums, counts, cost = np.zeros_like(matrix), np.zeros(len(matrix), np.int64), np.zeros(len(matrix))
        squares = (matrix * matrix).sum(axis=1)
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                rough = squares[None, :] - 2 * x @ matrix.T
                word = rough.argmin(axis=1)
                np.add.at(sums, word, x)
                np.add.at(cost, word, rough[np.arange(len(x)), word] + (x * x).sum(axis=1))
                counts += np.bincount(word, minlength=len(matrix))
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([s.tolist() for s in sums[own]], pa.list_(pa.float64())), pa.array(counts[own]), pa.array(cost[own])], names=["word", "sums", "n", "cost"])

    return run


def kmeans(features: DataFrame, words: int, iterations: int, seed: int = 9971, keep_empty: bool = False) -> DataFrame:
    """(word, vec): a vocabulary by Lloyd's iterations from randomly chosen features.

    A word that nothing is nearest to becomes the zero vector, or with ``keep_empty`` stays where it is. The vocabulary is
    the only thing on the driver.
    """
    spark = features.sparkSession
    first = features.orderBy(F.xxhash64("feat_id", F.lit(seed)), "feat_id").limit(words).select("vec").collect()
    matrix = np.array([r["vec"] for r in first], np.float64)
    for _ in range(iterations):
        if not len(matrix):
            break
        shared = spark.sparkContext.broadcast(matrix)
        parts = features.select("vec").mapInArrow(_assigned(shared), "word bigint, sums array<double>, n bigint, cost double")
        summed = parts.select("word", "n", F.posexplode("sums").alias("dim", "s")).groupBy("word", "dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        rows = summed.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("dim", "s"))).alias("sums"), F.max("n").alias("n")).collect()
        new = matrix.copy() if keep_empty else np.zeros_like(matrix)
        for r in rows:
            new[r["word"]] = np.array([x["s"] for x in r["sums"]]) / r["n"]
        matrix = new
        shared.unpersist()
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(matrix)], "word bigint, vec array<double>")


def rotation(residuals: DataFrame, bits: int, sample: int = SAMPLE, seed: int = 43) -> list[list[float]]:
    """A random orthonormal mixture of the residuals' first principal directions, from a bounded sample of them."""
    n = residuals.count()
    rows = residuals if n <= sample else residuals.filter(F.pmod(F.xxhash64("feat_id"), F.lit(n)) < sample)
    x = np.array([r["residual"] for r in rows.select("residual").limit(2 * sample).collect()], np.float64)
    _, _, directions = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    mixture, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (mixture @ directions[:bits]).tolist()


#: What an index is built with.
PRESETS = {
    "generic": {"use_root_sift": "TRUE", "sift_scale_3": "TRUE", "resize_dimension": "800x800", "bow_descriptor_count": "-1", "bow_cluster_count": "10000", "cluster_num_iteration": "30", "hamm_embedding_bits": "64"},
    "manual": {"use_root_sift": "TRUE", "sift_scale_3": "TRUE", "resize_dimension": "-1", "bow_descriptor_count": "-1", "bow_cluster_count": "-1", "cluster_num_iteration": "-1", "hamm_embedding_bits": "32"},
}
