"""Packs documents into sequences of at most ``WINDOW`` tokens with next to no padding.

A document's tokens are cut at multiples of the window; the whole windows are sequences of their own. The remainders go
by their lengths: shallow combinations of two or three lengths that fill a window are enumerated, non-negative least
squares finds how often each is to be used so that together they match the histogram of lengths, and the counts are
rounded by their largest remainders. What is left is packed greedily, longest first, each sequence being filled up with the start of the next
remainder; the last sequence is cut at powers of two, which need no padding.

Blocks of documents are packed on their own, in the task that reads them: nothing is shuffled and nothing waits for
anything else. A block's size bounds memory, and costs one last sequence.

Cases: a null text counts as empty and still has its closing id; a null doc_id stays null; repeated rows are packed once
each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from findlode.llm import textscan as ts
from findlode.llm.shared import only
from findlode.llm.tokens import encoder

WINDOW = 1024
#: Tokens of a block.
BLOCK_TOKENS = 1 << 24
END_ID = 0
#: A third length of a combination is a multiple of this; bounds the number of combinations.
GRAIN = 64
ROUNDS = 200
#: A combination whose count has a smaller remainder than this isn't rounded up.
LEAST_REMAINDER = 0.01
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def combinations(window: int = WINDOW, grain: int = GRAIN) -> np.ndarray:
    """Rows of three lengths in falling order that fill the window; the last may be 0. Pairs first."""
    pairs = [(window - b, b, 0) for b in range(1, window // 2 + 1)]
    triples = [(window - b - c, b, c) for c in range(grain, window // 3 + 1, grain) for b in range(c, (window - c) // 2 + 1)]
    return np.array(pairs + triples, np.int64)


def solve(combos: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Counts x >= 0 that make the combinations' lengths match the histogram best in the least-squares sense.

    Accelerated projected gradient: each step goes down the gradient, then to the nearest point without negatives.
    """
    n = len(histogram)
    used = combos > 0

    def lengths(x: np.ndarray) -> np.ndarray:
        return np.bincount(combos.ravel(), np.where(used, x[:, None], 0.0).ravel(), n)

    def back(r: np.ndarray) -> np.ndarray:
        return np.where(used, r[combos], 0.0).sum(axis=1)

    probe = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue, for the step
        probe = back(lengths(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    step = 1.0 / (1.02 * norm)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(lengths(y) - histogram))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def whole_counts(combos: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """The solution in whole numbers that the lengths suffice for: rounded down first, then up by the largest remainders."""
    floors = np.floor(x + 1e-6).astype(np.int64)
    counts = floors.copy()
    left = histogram.astype(np.int64)
    for k in np.argsort(-x, kind="stable"):
        if not counts[k]:
            continue
        own, times = np.unique(combos[k][combos[k] > 0], return_counts=True)
        counts[k] = min(counts[k], int((left[own] // times).min()))
        left[own] -= counts[k] * times
    over = x - floors
    for k in np.argsort(-over, kind="stable")[: np.count_nonzero(over > LEAST_REMAINDER)].tolist():
        a, b, c = combos[k].tolist()
        left[a] -= 1
        left[b] -= 1
        left[c] -= c > 0
        if min(left[a], left[b], left[c]) < 0:
            left[a] += 1
            left[b] += 1
            left[c] += c > 0
        else:
            counts[k] += 1
    return counts


def place(sizes: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of the given sizes; sequences count from 0."""
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for i, size in enumerate(sizes.tolist()):
        for start in range(0, size - window + 1, window):
            out.append((i, start, window, sequence, 0))
            sequence += 1
    rest = sizes % window
    histogram = np.bincount(rest, minlength=window)
    histogram[0] = 0
    turn = np.argsort(rest, kind="stable")
    first = np.searchsorted(rest[turn], np.arange(window + 1))  # documents of a length lie together
    taken = first[:-1].copy()
    if histogram.sum() > 1:
        combos = combinations(window)
        possible = ((histogram[combos] > 0) | (combos == 0)).all(axis=1)
        combos = combos[possible]
        if len(combos):
            counts = whole_counts(combos, solve(combos, histogram.astype(float)), histogram)
            for combo, count in zip(combos[counts > 0].tolist(), counts[counts > 0].tolist(), strict=True):
                for _ in range(count):
                    offset = 0
                    for length in combo:
                        if length:
                            i = int(turn[taken[length]])
                            taken[length] += 1
                            out.append((i, int(sizes[i]) - length, length, sequence, offset))
                            offset += length
                    sequence += 1
    offset = 0
    last: list[tuple[int, int, int]] = []  # the pieces of the sequence being filled
    for length in range(window - 1, 0, -1):
        for i in turn[taken[length] : first[length + 1]].tolist():
            start, left = int(sizes[i]) - length, length
            while left:
                part = min(left, window - offset)
                last.append((i, start, part))
                start, left, offset = start + part, left - part, offset + part
                if offset == window:
                    at = 0
                    for piece in last:
                        out.append((*piece, sequence, at))
                        at += piece[2]
                    sequence, offset, last = sequence + 1, 0, []
    # The unfilled sequence: parts of falling powers of two.
    room, at = (1 << offset.bit_length() - 1, 0) if offset else (0, 0)
    for i, start, length in last:
        while length:
            part = min(length, room - at)
            out.append((i, start, part, sequence, at))
            start, length, at, offset = start + part, length - part, at + part, offset - part
            if at == room:
                sequence += 1
                room, at = (1 << offset.bit_length() - 1, 0) if offset else (0, 0)
    return out


def _ids_of(path: str, texts: list[str | None], end_id: int) -> list[np.ndarray]:
    own = encoder(path)
    end = np.array([end_id], own.dtype)
    return [np.concatenate([ids, end]) for ids in own.encode([t or "" for t in texts])]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(docs: DataFrame, path: str | None = None, end_id: int = END_ID, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row per piece: where it lies in its document and in its sequence, and the crc32 of its ids.

    A sequence's id is the task's number and the sequence's number in the task, so a task that runs again says the same.
    """
    path = path or tokenizer_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        names, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal names, ids, held, base
            sizes = np.array([len(x) for x in ids], np.int64)
            pieces = place(sizes, window)
            crc = [zlib.crc32(ids[i][s : s + n].astype("<u4").tobytes()) for i, s, n, _, _ in pieces]
            doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array([names[i] for i in doc.tolist()], pa.int64()), *[pa.array(x, pa.int64()) for x in (start, length, crc, sizes[doc], sequence + base, offset)]], names=[f.split()[0] for f in SCHEMA.split(", ")])
            base += int(sequence.max()) + 1
            names, ids, held = [], [], 0
            return out

        for batch in batches:
            for a, b in ts.pieces(batch.column(1)):
                part = batch.slice(a, b - a)
                some = _ids_of(path, part.column(1).to_pylist(), end_id)
                names += part.column(0).to_pylist()
                ids += some
                held += sum(map(len, some))
                if held >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    return only(docs, "doc_id", "text").mapInArrow(pack, SCHEMA)
