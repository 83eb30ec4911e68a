"""Files of local features: text, siftgeo, fvecs and flat descriptor files.

Detectors are outside; an index takes features from any of these, or from a table
(doc_id, feat_id, x, y, a, b, c, vec).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of a flat file by their code, in the order of their codes.
DTYPES = ("uint8", "uint16", "uint32", "uint64", "float32", "float64")
FEATURES = "path string, feat_id bigint, x double, y double, a double, b double, c double, vec array<double>"

Rows = tuple[np.ndarray, np.ndarray]


class FeatureSource(Protocol):
    """Anything that makes a table of features for a table of documents."""

    def features(self, docs: DataFrame) -> DataFrame: ...


def read_text(data: bytes) -> Rows:
    """``dims`` and ``count``, then per feature x, y, a value without use, a, b, c and the descriptor."""
    values = data.split()
    dims, n = int(float(values[0])), int(values[1])
    rows = np.array(values[2 : 2 + n * (6 + dims)], float).reshape(n, 6 + dims)
    return rows[:, [0, 1, 3, 4, 5]], rows[:, 6:]


def read_regions(data: bytes) -> Rows:
    """A line without use, the count, then x, y, a, b, c per region; there are no descriptors."""
    values = data.split()
    n = int(values[1])
    return np.array(values[2 : 2 + 5 * n], float).reshape(n, 5), np.empty((n, 0))


def write_regions(regions: np.ndarray) -> bytes:
    lines = ["1.0", str(len(regions)), *(" ".join(f"{v:.10g}" for v in r) for r in regions)]
    return ("\n".join(lines) + "\n").encode()


def read_siftgeo(data: bytes) -> Rows:
    """Records of nine numbers of geometry, the dimension 128, and 128 bytes.

    Numbers 4 to 7 are a 2x2 matrix and number 2 a scale; the ellipse's matrix has the inverse squares of the scaled
    singular values on the matrix's right singular directions. y points down in images, which turns b's sign.
    """
    kind = np.dtype([("g", "<f4", 9), ("dims", "<i4"), ("v", "u1", 128)])
    rows = np.frombuffer(data[: len(data) // kind.itemsize * kind.itemsize], kind)
    if len(rows) and (rows["dims"] != 128).any():
        raise ValueError("a siftgeo record doesn't have 128 dimensions")
    g = rows["g"].astype(float)
    if not len(g):
        return np.empty((0, 5)), np.empty((0, 128))
    _, sizes, right = np.linalg.svd(g[:, 4:8].reshape(-1, 2, 2))
    v = np.swapaxes(right, 1, 2)
    inner = np.zeros((len(g), 2, 2))
    inner[:, 0, 0], inner[:, 1, 1] = (1 / (sizes * g[:, 2:3]) ** 2).T
    m = right @ inner @ v
    sign = np.where(np.linalg.det(v) > 0, 1.0, -1.0)
    return np.c_[g[:, 0], g[:, 1], m[:, 0, 0], -sign * m[:, 0, 1], m[:, 1, 1]], rows["v"].astype(float)


def read_fvecs(data: bytes) -> np.ndarray:
    """Rows of a dimension and so many floats."""
    if not data:
        return np.empty((0, 0))
    dims = struct.unpack("<i", data[:4])[0]
    return np.frombuffer(data, "<f4").reshape(-1, dims + 1)[:, 1:].astype(float)


def read_flat(data: bytes, first_dims: int = 0, unit: bool = False) -> np.ndarray:
    """A header of dimension (4 bytes) and type code (1 byte), then the values; optionally the first dimensions only, of unit length."""
    dims, code = struct.unpack("<IB", data[:5])
    if code >= len(DTYPES):
        raise ValueError(f"unknown type code {code}")
    rows = np.frombuffer(data[5:], np.dtype(DTYPES[code]).newbyteorder("<")).reshape(-1, dims).astype(float)
    if first_dims:
        rows = rows[:, :first_dims]
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12) if unit else rows


def write_flat(rows: np.ndarray) -> bytes:
    return struct.pack("<IB", rows.shape[1], DTYPES.index(rows.dtype.name)) + rows.astype(rows.dtype.newbyteorder("<")).tobytes()


def from_files(spark: SparkSession, folder: str, pattern: str, reader: Callable[[bytes], Rows]) -> DataFrame:
    """Features of all files below a folder that match the pattern, a file's in a task."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shapes, vectors = reader(data)
                n = len(shapes)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(n)), *[pa.array(shapes[:, k]) for k in range(5)], pa.array(list(vectors), pa.list_(pa.float64()))], names=[f.split()[0] for f in FEATURES.split(", ")])

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", "content").mapInArrow(load, FEATURES)


def vectors_from_files(spark: SparkSession, folder: str, pattern: str, reader: Callable[[bytes], np.ndarray]) -> DataFrame:
    """As above, of files that have descriptors alone."""
    return from_files(spark, folder, pattern, lambda data: (lambda v: (np.zeros((len(v), 5)), v))(reader(data))).select("path", "feat_id", "vec")


def ranged(features: DataFrame, start: int, end: int) -> DataFrame:
    """Features from number ``start`` up to ``end``."""
    return features.filter((F.col("feat_id") >= start) & (F.col("feat_id") < end))
