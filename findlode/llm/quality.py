"""Quality rules as a short-circuit cascade.

A document goes through rules one after another; one that a rule rejects is not shown to the next, and the figures that
the next ones need are not worked out for it. The order is found on a sample: there every rule is timed from the words
on, with all figures that it needs, and rules go by rejections per second. The order changes the cost, never the verdict.
The base test is two of the rules. Where figures are returned beside the verdict (``quality_rules``), those are worked
out for all documents; where they aren't (``keep_good``), nothing is.

Cases: a null text counts as empty; a text without words has figures of 0 and fails the base test; an empty table gives
an empty result; of extra columns none is read; repeated rows each get their row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlode.llm import textscan as ts
from findlode.llm.shared import only, unnamed
from findlode.llm.tokens import release

#: The symbols counted.
SYMBOLS = b"#*$%&|<>"
#: The rules are timed on so many texts, of no more bytes than this each.
SAMPLE_ROWS = 512
SAMPLE_BYTES = 1 << 18

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


class Texts:
    """A run of texts with the figures that rules ask for; a figure is worked out for the rows it is asked of, once."""

    def __init__(self, column: pa.Array) -> None:
        self.buf, self.offsets = ts.texts(column)
        self.starts, self.ends, self.hashes, self.first = ts.words_of(self.buf, self.offsets, lower=False)
        self.n_words = np.diff(self.first)
        self.rows = np.arange(len(self.n_words))
        self._known: dict[str, np.ndarray] = {}

    def figure(self, name: str, rows: np.ndarray | None = None) -> np.ndarray:
        """The figure of ``rows``, or of all."""
        rows = self.rows if rows is None else rows
        known = self._known.setdefault(name, np.full(len(self.n_words), -1))
        missing = rows[known[rows] < 0]
        for run in np.split(missing, np.flatnonzero(np.diff(missing) != 1) + 1) if len(missing) else ():
            a, b = int(run[0]), int(run[-1]) + 1
            known[a:b] = getattr(self, f"_{name}")(a, b)
        return known[rows]

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(self.rows, self.n_words)

    @staticmethod
    def _running(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=out[1:])
        return out

    def _within(self, a: int, b: int) -> tuple[np.ndarray, int, slice, np.ndarray]:
        """The bytes of the rows from a to b, where they begin, their words, and whose word each is."""
        lo = int(self.offsets[a])
        return self.buf[lo : int(self.offsets[b])], lo, slice(int(self.first[a]), int(self.first[b])), np.repeat(np.arange(b - a), self.n_words[a:b])

    def _times(self, owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key whether it equals an earlier one of its text, and how often it occurs there."""
        _, first, which, counts = np.unique(ts.mix(keys + owner.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), return_index=True, return_inverse=True, return_counts=True)
        later = np.ones(len(keys), bool)
        later[first] = False
        return later, counts[which]

    def _n_symbols(self, a: int, b: int) -> np.ndarray:
        buf, lo, _, _ = self._within(a, b)
        return np.diff(self._running(_SYMBOL[buf])[self.offsets[a : b + 1] - lo])

    def _word_chars(self, a: int, b: int) -> np.ndarray:
        buf, lo, words, owner = self._within(a, b)
        sums = self._running((buf & 0xC0) != 0x80)
        return np.bincount(owner, sums[self.ends[words] - lo] - sums[self.starts[words] - lo], b - a)

    def _worded_lines(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        buf, lo, words, _ = self._within(a, b)
        offsets = self.offsets[a : b + 1] - lo
        begin, end = ts.runs(buf, offsets, _NOT_NEWLINE)
        starts = self.starts[words] - lo
        worded = np.searchsorted(starts, begin) < np.searchsorted(starts, end)
        begin, end = begin[worded], end[worded]
        return np.searchsorted(offsets, begin, "right") - 1, begin + lo, end + lo

    def _n_lines(self, a: int, b: int) -> np.ndarray:
        return np.bincount(self._worded_lines(a, b)[0], minlength=b - a)

    def _n_dup_lines(self, a: int, b: int) -> np.ndarray:
        owner, begin, end = self._worded_lines(a, b)
        self._known.setdefault("n_lines", np.full(len(self.n_words), -1))[a:b] = np.bincount(owner, minlength=b - a)
        later, _ = self._times(owner, ts.span_hashes(self.buf, begin, end))
        return np.bincount(owner[later], minlength=b - a)

    def _n_repeat_words(self, a: int, b: int) -> np.ndarray:
        _, _, words, owner = self._within(a, b)
        keys = ts.windows(self.hashes[words])
        at = np.flatnonzero(owner[: len(keys)] == owner[ts.SHINGLE - 1 :][: len(keys)]) if len(keys) else np.empty(0, np.int64)
        twice = self._times(owner[at], keys[at])[1] > 1
        edges = np.zeros(len(owner) + 1, np.int64)
        np.add.at(edges, at[twice], 1)
        np.add.at(edges, at[twice] + ts.SHINGLE, -1)
        return np.bincount(owner[np.cumsum(edges)[:-1] > 0], minlength=b - a)

    def _with(self, flags: np.ndarray, a: int, b: int) -> np.ndarray:
        """The words that hold a byte of the class."""
        buf, lo, words, owner = self._within(a, b)
        sums = self._running(flags[buf])
        return np.bincount(owner[sums[self.ends[words] - lo] > sums[self.starts[words] - lo]], minlength=b - a)

    def _lettered(self, a: int, b: int) -> np.ndarray:
        return self._with(_LETTER, a, b)

    def _numbered(self, a: int, b: int) -> np.ndarray:
        return self._with(_DIGIT, a, b)

    def _commonest(self, a: int, b: int) -> np.ndarray:
        """How often the commonest word occurs."""
        _, _, words, owner = self._within(a, b)
        out = np.zeros(b - a, np.int64)
        np.maximum.at(out, owner, self._times(owner, self.hashes[words])[1])
        return out


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets texts and row numbers and says of each row whether the rule rejects it."""

    name: str
    rejects: Callable[[Texts, np.ndarray], np.ndarray]


BASE = (
    Rule("few_words", lambda t, r: t.n_words[r] < 10),
    Rule("repeats", lambda t, r: 100 * t.figure("n_repeat_words", r) > 20 * t.n_words[r]),
)
RULES = (
    Rule("symbols", lambda t, r: 10 * t.figure("n_symbols", r) > t.n_words[r]),
    Rule("word_length", lambda t, r: (t.figure("word_chars", r) < 2 * t.n_words[r]) | (t.figure("word_chars", r) > 15 * t.n_words[r])),
    Rule("duplicate_lines", lambda t, r: 10 * t.figure("n_dup_lines", r) > 5 * t.figure("n_lines", r)),
    Rule("letterless_words", lambda t, r: 10 * t.figure("lettered", r) < 5 * t.n_words[r]),
    Rule("digit_words", lambda t, r: 10 * t.figure("numbered", r) > 5 * t.n_words[r]),
    Rule("one_word", lambda t, r: 10 * t.figure("commonest", r) > 3 * t.n_words[r]),
)

FIGURES = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"


def base_failed(t: Texts) -> np.ndarray:
    return np.logical_or(*(rule.rejects(t, t.rows) for rule in BASE))


def measured(column: pa.Array, rules: tuple[Rule, ...]) -> dict[str, tuple[float, int, int]]:
    """For each rule its seconds, rejections and texts; no rule gains from what another has worked out."""
    found = dict.fromkeys((r.name for r in rules), (0.0, 0, 0))
    for a, b in ts.pieces(column):
        t = Texts(column.slice(a, b - a))
        for rule in rules:
            t._known.clear()
            began = time.perf_counter()
            hits = int(np.count_nonzero(rule.rejects(t, t.rows)))
            s, h, n = found[rule.name]
            found[rule.name] = (s + time.perf_counter() - began, h + hits, n + b - a)
    return found


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejections per second, as measured on a sample of a bounded number of bytes.

    Spark takes the sample from the first input splits that yield it and leaves the others alone.
    """
    rows = only(docs, "text").filter(F.octet_length("text") <= SAMPLE_BYTES).limit(sample_rows).collect()
    found = measured(pa.array([r[0] for r in rows], pa.string()), rules)

    def rate(name: str) -> float:
        s, hits, seen = found[name]
        return (hits + 1) / (seen + 2) / max(s, 1e-9)

    return tuple(sorted(rules, key=lambda r: (-rate(r.name), r.name)))


def with_base(order: tuple[Rule, ...]) -> tuple[Rule, ...]:
    return tuple(order) + tuple(rule for rule in BASE if rule not in order)


def verdicts(t: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """For each text whether it passes all rules; a rule sees only what earlier ones let through."""
    kept = np.ones(len(t.n_words), bool)
    for rule in rules:
        rows = np.flatnonzero(kept)
        if not len(rows):
            break
        kept[rows[rule.rejects(t, rows)]] = False
    return kept


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: tuple[Rule, ...] | None = None) -> DataFrame:
    """A row per document with its figures and verdict. One pass, no shuffle."""
    ordered = with_base(order or cascade_order(docs, BASE + rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b in ts.pieces(batch.column(1)):
                t = Texts(batch.column(1).slice(a, b - a))
                numbers = [t.n_words, *(t.figure(name) for name in FIGURES)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), *[pa.array(x, pa.int64()) for x in numbers], pa.array(base_failed(t)), pa.array(verdicts(t, ordered))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return only(docs, "doc_id", "text").mapInArrow(judge, SCHEMA)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: tuple[Rule, ...] | None = None) -> DataFrame:
    """The documents that pass, with all their columns. One pass, no shuffle and no join."""
    ordered = with_base(order or cascade_order(docs, BASE + rules))
    at = docs.columns.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b in ts.pieces(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(verdicts(Texts(part.column(at)), ordered)))

    return unnamed(docs).mapInArrow(sift, docs.schema)
