import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from findlode.llm import packing, privacy
from findlode.llm.tokens import Encoder
from tests.llm.test_neardup import brute as groups
from tests.llm.test_privacy import brute as personal
from tests.llm.test_quality import brute as quality
from tests.llm.test_textscan import brute_shingles


def redacted(text):
    out, at = [], 0
    for a, k, b in sorted(personal(text), key=lambda s: (s[0], s[2], s[1])):
        if a >= at:
            out += [text[at:a], f"<{privacy.KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@pytest.fixture(scope="module")
def expected(spark, small):
    """doc_id -> text after the fourth stage, by plain loops."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = [(d, t) for d, t in rows if quality(t)["kept"]]
    own = groups(rows)
    rows = [(d, t) for d, t in rows if own[d][1] == d]
    items = [brute_shingles(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if not any(q and 100 * len(q & brute_shingles(t)) >= 75 * len(q) for q in items)]
    return {d: redacted(t) for d, t in rows}


def test_run_packs_what_the_stages_leave(spark, small, expected):
    encoder = Encoder(packing.tokenizer_path())
    by, sequences = defaultdict(list), defaultdict(int)
    for r in corpus_pipeline.run(spark, small).collect():
        by[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]] += r["length"]
    assert set(by) == set(expected) and 50 < len(by) < 200
    for d, text in expected.items():
        ids = np.array([*encoder.tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4")
        at = 0
        for start, length, crc in sorted(by[d]):
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    assert all(n <= 1024 and n & (n - 1) == 0 for n in sequences.values())


def test_stages_return_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), small).columns == docs.columns
