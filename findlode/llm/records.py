"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A folder holds ``shard-NNNNN.rec`` files and an index. Documents are in ascending doc_id order over the shards taken one
after another (documents without an id first; rows of one id by their texts' hashes, so that a task that runs again
writes the same). A record is

    length of the payload   8 bytes, unsigned, little-endian
    masked crc32 of these   4 bytes
    payload                 doc_id (8 bytes, signed), flags (1 byte: 1 for no doc_id, 2 for 16-bit ids), zstd-packed ids
    masked crc32 of it      4 bytes

where a crc c is masked as ((c >> 15 | c << 17) + 0xa282ead8) mod 2**32, so that checksums of data that hold checksums
stay sound. The index has for each record its shard, its byte offset there, the ids before it in the shard, and its
number of ids.

Each shard is written by one task under a name of its own and renamed when it is whole, so a task that runs twice, or
dies, leaves nothing half-written under a final name.

Cases: a null text counts as empty and has its end id alone; repeated rows have a record each; an empty table gives a
folder without records and an empty result; extra columns are not read.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findlode.llm import textscan as ts
from findlode.llm.packing import tokenizer_path
from findlode.llm.shared import Scratch, only
from findlode.llm.tokens import encoder, release

END_ID = 2
#: Bytes of text of a shard, about, at most.
SHARD_BYTES = 1 << 30
_HEAD, _OWN, _CRC = "<QI", "<qB", "<I"
_OWN_SIZE = struct.calcsize(_OWN)
INDEX = "doc_id bigint, shard int, byte_offset bigint, local_start bigint, n_tokens bigint"
RECORDS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


class Damaged(ValueError):
    """A record whose checksum or length is wrong."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def payload(doc_id: int | None, ids: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    return struct.pack(_OWN, doc_id or 0, (doc_id is None) | 2 * (ids.dtype.itemsize == 2)) + pack.compress(ids.tobytes())


def framed(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join([length, struct.pack(_CRC, masked(length)), data, struct.pack(_CRC, masked(data))])


def record(stream: io.BufferedIOBase) -> tuple[int | None, np.ndarray] | None:
    """The next record's doc_id and ids, or None at the end."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12:
        raise Damaged("a record ends early")
    length, crc = struct.unpack(_HEAD, head)
    if masked(head[:8]) != crc:
        raise Damaged("a record's length is damaged")
    data, crc = stream.read(length), stream.read(4)
    if len(data) < length or len(crc) < 4:
        raise Damaged("a record ends early")
    if masked(data) != struct.unpack(_CRC, crc)[0]:
        raise Damaged("a record is damaged")
    doc_id, flags = struct.unpack_from(_OWN, data)
    ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[_OWN_SIZE :]), "<u2" if flags & 2 else "<u4")
    return None if flags & 1 else doc_id, ids


def _place(folder: str, shard: int) -> tuple[pyarrow.fs.FileSystem, str]:
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    return system, f"{path}/shard-{shard:05d}.rec"


def write_records(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Writes all documents to ``folder``, an address that all executors reach, and returns the index, written there too.

    Texts are dealt out by ranges of (doc_id, hash of the text), so that rows of one doc_id, or without any, may fill
    several shards; a shard's task encodes, frames and writes in one go. Shards have about ``SHARD_BYTES`` of text at most.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path()
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("hash"))
    if not shards:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    system, local = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(local, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        own, pack = encoder(path), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], own.dtype)
        shard, stream, at, start = context.partitionId(), None, 0, 0
        system, final = _place(folder, shard)
        mine = f"{final}.{context.taskAttemptId()}"
        for batch in batches:
            for a, b in ts.pieces(batch.column(1)):
                part = batch.slice(a, b - a)
                places, starts, counts = [], [], []
                stream = stream or system.open_output_stream(mine, buffer_size=1 << 20)
                for doc_id, ids in zip(part.column(0).to_pylist(), own.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    frame = framed(payload(doc_id, np.concatenate([ids, end]), pack))
                    stream.write(frame)
                    places.append(at)
                    starts.append(start)
                    counts.append(len(ids) + 1)
                    at, start = at + len(frame), start + counts[-1]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(b - a, shard, np.int32)), *[pa.array(x, pa.int64()) for x in (places, starts, counts)]], names=[f.split()[0] for f in INDEX.split(", ")])
        if stream:
            stream.close()
            system.move(mine, final)

    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc()]
    placed = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    placed.mapInArrow(write, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def shard_starts(index: DataFrame) -> DataFrame:
    """(shard, base): the ids of all shards before each shard. A row per shard goes through one window."""
    sums = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return sums.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record, read from the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    shards = shard_starts(index)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[f.split()[0] for f in RECORDS.split(", ")])

        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = _place(folder, shard)
                rows = []
                with system.open_input_stream(path, buffer_size=1 << 20) as stream:
                    while (found := record(stream)) is not None:
                        doc_id, ids = found
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 5000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    n = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    return shards.repartitionById(n, "shard").mapInArrow(load, RECORDS)


def read_some(wanted: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids) of the index rows asked for, in any order, each by its byte offset."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = _place(folder, shard)
                with system.open_input_file(path) as stream:
                    stream.seek(offset)
                    out.append(record(stream))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array([i.tolist() for _, i in out], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return only(wanted, "shard", "byte_offset").mapInArrow(load, "doc_id bigint, ids array<bigint>")


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes all documents to a scratch folder and returns what reading it gives."""
    scratch = Scratch(docs.sparkSession, "records")
    write_records(docs, scratch.path, path, end_id)
    return scratch.result(read_records(docs.sparkSession, scratch.path))
