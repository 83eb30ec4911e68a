import io
import zlib

import numpy as np
import pyarrow.fs
import pytest

from findlode.llm import packing, records
from findlode.llm.tokens import Encoder


@pytest.fixture(scope="module")
def encoder():
    return Encoder(packing.tokenizer_path())


def ids_of(encoder, text):
    return np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, records.END_ID], "<u4")


def test_round_trip(docs_of, encoder, odd):
    texts = ["some text", *odd, "The last one.\nEnds here."]
    rows = [((7 * i) % len(texts) - 3, t) for i, t in enumerate(texts)]
    got = [tuple(r) for r in records.round_trip(docs_of(rows, extra=True)).collect()]
    start, want = 0, []
    for d, t in sorted(rows):
        ids = ids_of(encoder, t)
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got) == want


def test_null_ids_come_first_and_repeats_have_their_own_records(docs_of, encoder):
    rows = [(3, "three"), (None, "none"), (3, "three"), (1, None)]
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in records.round_trip(docs_of(rows)).collect())
    n, three = len(ids_of(encoder, "none")), len(ids_of(encoder, "three"))
    assert got == [(0, None, n), (n, 1, 1), (n + 1, 3, three), (n + 1 + three, 3, three)]


def test_empty_table(docs_of):
    assert records.round_trip(docs_of(["x"]).limit(0)).count() == 0


def test_shuffled_reads_by_the_index(spark, docs_of, encoder, tmp_path):
    texts = [f"text number {i} of some" for i in range(50)]
    folder = f"file://{tmp_path}/out"
    index = records.write_records(docs_of(texts), folder, shards=7)
    assert index.select("shard").distinct().count() > 3
    wanted = index.filter("doc_id % 3 = 0").orderBy("byte_offset")
    got = {r["doc_id"]: r["ids"] for r in records.read_some(wanted, folder).collect()}
    assert got == {i: ids_of(encoder, texts[i]).tolist() for i in range(0, 50, 3)}
    # a shard's ids are all below the next one's, and nothing unfinished is left behind
    edges = sorted((r["shard"], r["lo"], r["hi"]) for r in index.groupBy("shard").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "lo").join(index.groupBy("shard").agg({"doc_id": "max"}).withColumnRenamed("max(doc_id)", "hi"), "shard").collect())
    assert all(a[2] < b[1] for a, b in zip(edges, edges[1:]))
    names = [f.base_name for f in pyarrow.fs.LocalFileSystem().get_file_info(pyarrow.fs.FileSelector(f"{tmp_path}/out"))]
    assert all(n.endswith(".rec") or n == "index" for n in names)


def test_damage_is_noticed():
    import zstandard

    data = records.framed(records.payload(5, np.array([1, 2, 3], "<u2"), zstandard.ZstdCompressor()))
    assert records.record(io.BytesIO(data))[1].tolist() == [1, 2, 3] and records.record(io.BytesIO(b"")) is None
    for k in range(len(data)):
        broken = bytearray(data)
        broken[k] ^= 1
        with pytest.raises(records.Damaged):
            records.record(io.BytesIO(bytes(broken)))
    for k in range(1, len(data)):
        with pytest.raises(records.Damaged):
            records.record(io.BytesIO(data[:k]))
