"""Benchmark items inside documents: MinHash containment search by size, confirmed by exact shingle containment.

Jaccard similarity of a short item and a long document is low however much of the item the document holds, so both are
brought to one size. Items are partitioned by the logarithm of their shingle count; for each size, a document is read in
windows of two blocks, each block as long as the largest item of that size, so that a passage of an item's length lies
whole in some window. Item and window then have a similarity of at least 0.176 where three quarters of the item are
there, and share one of ``HASHES`` minimum values but with probability 4e-6. Items of fewer than eight shingles are
looked up by each shingle. A candidate is confirmed on the whole document: 100 * shared shingles >= 75 * the item's.

Items are a query set: they are taken in blocks of ``BLOCK_ITEMS``, each broadcast to a pass over the documents.

Cases: a null or wordless text holds nothing and is held by nothing; an item of fewer than five words is one shingle,
its whole sequence, which only documents of just these words share; repeated rows and items give a row each; empty
tables give an empty result; extra columns are not read, and ``without_items`` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlode.llm import textscan as ts
from findlode.llm.shared import only, unnamed

HASHES = 64
PERCENT = 75
TINY = 8
LEAST_BLOCK = 16
#: Items of a block; some hundred shingles each make a block of about 50 MB.
BLOCK_ITEMS = 20_000
_BITS = 22

_rng = np.random.default_rng(11)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALT = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)

SCHEMA = "doc_id bigint, item_id bigint, shared bigint, item_shingles bigint, containment double"


def _upper(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


class _Lookup:
    """Sorted keys with the items they belong to, behind a bit table that turns most other keys away."""

    def __init__(self, keys: list[tuple[int, int]], n: int) -> None:
        keys = sorted(keys)
        self.keys = np.array([k for k, _ in keys], np.uint64)
        self.items = np.array([i for _, i in keys], np.int64)
        self.table = np.zeros(1 << _BITS, bool)
        if n:
            self.table[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in keys, item) of all keys found."""
        at = np.flatnonzero(self.table[self._slot(keys)])
        lo, hi = np.searchsorted(self.keys, keys[at]), np.searchsorted(self.keys, keys[at], "right")
        n = hi - lo
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.items[np.repeat(lo, n) + within]


class Items:
    """A block of items, ready to be looked for."""

    def __init__(self, ids: list[int | None], texts: list[str | None]) -> None:
        sets = list(ts.shingle_sets(pa.array(texts, pa.string())))
        self.ids, self.sets = ids, sets
        tiny: list[tuple[int, int]] = []
        by_size: dict[int, list[tuple[int, int]]] = {}
        for i, s in enumerate(sets):
            if len(s) < TINY:
                tiny += [(int(h), i) for h in s]
            else:
                least = ((_upper(s)[None, :] ^ _XOR[:, None]) * _TIMES[:, None]).min(axis=1)
                by_size.setdefault(int(len(s)).bit_length() - 1, []).extend((j << 32 | int(v), i) for j, v in enumerate(least))
        self.tiny = _Lookup(tiny, len(tiny)) if tiny else None
        self.by_size = {c: _Lookup(keys, len(keys)) for c, keys in sorted(by_size.items())}

    def candidates(self, docs: list[np.ndarray]) -> list[tuple[int, int]]:
        """(document, item) pairs that share a value. docs: each document's shingles in the order of its text."""
        found: list[np.ndarray] = []
        if self.tiny:
            own = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
            at, items = self.tiny.find(np.concatenate([*docs, np.empty(0, np.uint64)]))
            found.append(np.c_[own[at], items])
        # Documents lie one after another, each padded to a multiple of the least block.
        blocks = np.array([-(-len(d) // LEAST_BLOCK) for d in docs], np.int64)
        if self.by_size and blocks.sum():
            starts = np.cumsum(blocks) - blocks
            line = np.zeros(blocks.sum() * LEAST_BLOCK, np.uint32)
            real = np.zeros(len(line), bool)
            for d, s in zip(docs, starts * LEAST_BLOCK, strict=True):
                line[s : s + len(d)] = _upper(d)
                real[s : s + len(d)] = True
            least = np.empty((HASHES, blocks.sum()), np.uint32)
            for j in range(HASHES):
                values = (line ^ _XOR[j]) * _TIMES[j]
                values[~real] = 0xFFFFFFFF
                least[j] = values.reshape(-1, LEAST_BLOCK).min(axis=1)
            owner = np.repeat(np.arange(len(docs)), blocks)
            place = np.arange(len(owner)) - starts[owner]
            for c, lookup in self.by_size.items():
                wide = max(1, (2 << c) // LEAST_BLOCK)  # least blocks in a block of this size
                heads = np.flatnonzero(place % wide == 0)
                mins = np.minimum.reduceat(least, heads, axis=1)  # heads of all documents, so no block crosses two
                same = owner[heads[:-1]] == owner[heads[1:]]
                mins[:, :-1] = np.where(same, np.minimum(mins[:, :-1], mins[:, 1:]), mins[:, :-1])
                keys = (np.arange(HASHES, dtype=np.uint64)[:, None] << np.uint64(32)) | mins.astype(np.uint64)
                at, items = lookup.find(keys.ravel())
                found.append(np.c_[owner[heads[at % len(heads)]], items])
        pairs = np.unique(np.concatenate([*found, np.empty((0, 2), np.int64)]), axis=0)
        return [(int(d), int(i)) for d, i in pairs]

    def held(self, column: pa.Array, percent: int = PERCENT) -> list[tuple[int, int, int, int]]:
        """(row, item, shared shingles, the item's shingles) of all items that the texts hold."""
        out = []
        for a, b in ts.pieces(column):
            buf, offsets = ts.texts(column.slice(a, b - a))
            _, _, hashes, first = ts.words_of(buf, offsets)
            words = [hashes[first[i] : first[i + 1]] for i in range(b - a)]
            docs = [ts.windows(w) if len(w) >= ts.SHINGLE else ts.shingles(w) for w in words]
            own, last = None, -1
            for d, i in self.candidates(docs):
                if d != last:
                    own, last = np.unique(docs[d]), d
                s = self.sets[i]
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                n = int(np.count_nonzero(own[at] == s))
                if n and 100 * n >= percent * len(s):
                    out.append((a + d, i, n, len(s)))
        return out


def item_blocks(items: DataFrame, block_items: int = BLOCK_ITEMS) -> list[Broadcast]:
    """The items in broadcast blocks of about ``block_items``."""
    spark = items.sparkSession
    chosen = only(items, "item_id", "text").filter("text is not null")
    n = -(-chosen.count() // block_items)
    out = []
    for k in range(n):
        some = chosen.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else chosen
        rows = some.collect()
        out.append(spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows])))
    return out


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """A row for each document and item it holds. One pass over the documents for each block of items, no shuffle."""

    def search(block: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = block.value.held(batch.column(1), percent)
                docs_, items_, shared, size = zip(*found, strict=True) if found else ((),) * 4
                ids = batch.column(0).cast(pa.int64()).take(pa.array(docs_, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([block.value.ids[i] for i in items_], pa.int64()), pa.array(shared, pa.int64()), pa.array(size, pa.int64()), pa.array([n / m for n, m in zip(shared, size, strict=True)], pa.float64())], names=[f.split()[0] for f in SCHEMA.split(", ")])

        return run

    out = docs.sparkSession.createDataFrame([], SCHEMA)
    blocks = item_blocks(items, block_items)
    texts = only(docs, "doc_id", "text")
    for k, block in enumerate(blocks):
        found = texts.mapInArrow(search(block), SCHEMA)
        out = found if k == 0 else out.unionByName(found)
    return out


def without_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents that hold no item, with all their columns. Passes without shuffle or join."""
    at = docs.columns.index("text")

    def sift(block: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[row for row, *_ in block.value.held(batch.column(at), percent)]] = False
                yield batch.filter(pa.array(keep))

        return run

    out = docs
    for block in item_blocks(items, block_items):
        out = unnamed(out).mapInArrow(sift(block), docs.schema)
    return out
