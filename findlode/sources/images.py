"""Image folders: listing, size by header, and what preprocessing would make of them.

Pixels aren't decoded here; an image's size and validity come from its header.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The suffixes that are taken, in small letters or in capitals.
SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff")
SIZED = "path string, width int, height int, reason string"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def taken(path: Column) -> Column:
    """Whether a path's suffix is one of those taken; mixed case isn't."""
    suffix = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    return suffix.isin(*SUFFIXES, *(s.upper() for s in SUFFIXES))


def additions(found: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, discarded): files to add, and those that are known already or of another kind, with the reason. known: (path)."""
    new = found.filter(taken(F.col("path"))).join(known.select("path"), "path", "left_anti")
    other = found.filter(~taken(F.col("path"))).select("path", F.lit("not an image").alias("reason"))
    again = found.filter(taken(F.col("path"))).join(known.select("path"), "path", "left_semi").select("path", F.lit("exists").alias("reason"))
    return new, other.unionByName(again)


def size_of(data: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG's, JPEG's or TIFF's header; None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data):
            if data[at] != 0xFF:
                return None
            mark = data[at + 1]
            if mark == 0xFF:
                at += 1
                continue
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 if 0xD0 <= mark <= 0xD9 or mark == 1 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        return None
    if data[:4] in (b"II*\0", b"MM\0*") and len(data) >= 8:
        order = "<" if data[:2] == b"II" else ">"
        at = struct.unpack(order + "I", data[4:8])[0]
        if at + 2 > len(data):
            return None
        found = {}
        for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) == 12:
                tag, kind = struct.unpack(order + "HH", entry[:4])
                if tag in (256, 257):
                    found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
        return (found[256], found[257]) if len(found) == 2 else None
    return None


def sized(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, reason): every image's size, or why it has none."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [size_of(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s and s[0] for s in sizes], pa.int32()), pa.array([s and s[1] for s in sizes], pa.int32()), pa.array([None if s else "not an image, or a damaged one" for s in sizes])], names=["path", "width", "height", "reason"])

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(taken(F.col("path"))).select("path", "content")
    return rows.mapInArrow(look, SIZED)


def resized(width: Column, height: Column, limit: str) -> Column:
    """The size after shrinking into ``WxH``; nothing is enlarged, and -1 leaves all as it is."""
    if limit == "-1":
        return F.struct(width.alias("width"), height.alias("height"))
    w, h = (float(x) for x in limit.split("x"))
    scale = F.least(F.lit(1.0), F.lit(w) / width, F.lit(h) / height)
    whole = lambda x: F.greatest(F.lit(1), F.round(x * scale).cast("int"))
    return F.struct(whole(width).alias("width"), whole(height).alias("height"))


def preprocessed(images: DataFrame, limit: str) -> tuple[DataFrame, DataFrame]:
    """(docs, rejected): images numbered in the order of their paths, with old and new sizes; and those without a size.

    The numbers come from sorted ranges, not from one task.
    """
    good = images.filter("reason is null")
    numbered = good.orderBy("path").select("path", "width", "height", F.monotonically_increasing_id().alias("at"))
    part = numbered.withColumn("part", F.shiftright("at", 33)).withColumn("within", F.col("at").bitwiseAND((1 << 33) - 1))
    counts = part.groupBy("part").agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window

    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    new = resized(F.col("width"), F.col("height"), limit)
    docs = part.join(F.broadcast(before), "part").select((F.col("before") + F.col("within")).alias("doc_id"), F.col("path").alias("filename"), "width", "height", new.alias("new"))
    return docs.select("doc_id", "filename", "width", "height", F.col("new.width").alias("new_width"), F.col("new.height").alias("new_height")), images.filter("reason is not null").select("path", "reason")
