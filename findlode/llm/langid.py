"""Language by prediction by partial matching over bytes.

Every language has a tree of byte contexts of 0 to ``ORDER`` bytes, counted on a sample of labelled texts and then
frozen. A byte costs -log2(count / (total + distinct)) in the longest context that the language knows and that has seen
it; each longer known context costs an escape, -log2(distinct / (total + distinct)); a byte that no context has seen
costs 8 bits after the last escape. A text's code length in a language is the sum over all its bytes, and the language
with the shortest code is the prediction.

The trees of all languages share their nodes: a node's place is found from its parent's place and a byte by one table
look-up for all bytes of a batch at once, and holds the costs for all languages, escapes included, so lengths are exact.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text where nothing could be learned
from; ties go to the language first in order; a null doc_id is learned from by nobody and not held out; repeated rows
each get their row; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlode.llm import textscan as ts
from findlode.llm.shared import Scratch, only

#: Bytes of context at most.
ORDER = 3
#: Distinct texts that are learned from per language, about.
SAMPLE_TEXTS = 250
#: Bytes of them, at most, beyond a language's first text.
SAMPLE_BYTES = 4 << 20
_PIECE = 1 << 19
_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


class Trees:
    """The frozen trees. Level k holds the strings of k bytes seen in any language; place 0 stands for none."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER) -> None:
        self.languages = sorted(samples)
        self.order = order
        n = len(self.languages)
        buf, offsets, lang = [], [0], []
        for k, name in enumerate(self.languages):
            for text in samples[name]:
                buf.append(text)
                offsets.append(offsets[-1] + len(text))
                lang.append(np.full(len(text), k, np.int32))
        line = np.frombuffer(b"".join(buf), np.uint8)
        owner = np.concatenate([*lang, np.empty(0, np.int32)])
        head = np.zeros(len(line) + 1, bool)
        head[np.array(offsets)] = True
        head = head[: len(line)]
        seen = np.unique(line)
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        place = self.symbol[line].astype(np.int32)
        counts = np.bincount(place.astype(np.int64) * n + owner, minlength=self.width * n).reshape(-1, n).astype(float)
        self.tables: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        total, distinct = counts.sum(axis=0), (counts > 0).sum(axis=0)
        escape = -np.log2(np.maximum(distinct, 1) / np.maximum(total + distinct, 1))
        cost = np.where(counts > 0, -np.log2(np.maximum(counts, 1) / np.maximum(total + distinct, 1)), escape + 8.0)
        self.costs.append(cost.astype(np.float32))
        symbols, suffix_of = place, np.zeros(self.width, np.int64)
        for _ in range(order):
            before = np.concatenate([np.zeros(1, np.int32), place[:-1]])
            before[head] = 0
            known = before > 0
            real, which = np.unique(before[known].astype(np.int64) * self.width + symbols[known], return_inverse=True)
            table = np.zeros((len(counts), self.width), np.int32)
            table.ravel()[real] = np.arange(1, len(real) + 1)
            new = np.zeros(len(line), np.int32)
            new[known] = which + 1
            del which, known
            parents = np.concatenate([[0], real // self.width])
            # The same bytes without the first: the node one level up that this string ends with.
            suffix_of = np.zeros(len(real) + 1, np.int64)
            suffix_of[new] = place
            suffix_of[0] = 0
            counts = np.bincount(new.astype(np.int64) * n + owner, minlength=(len(real) + 1) * n).reshape(-1, n).astype(float)
            counts[0] = 0
            total, distinct = (np.zeros((len(table), n)) for _ in range(2))
            np.add.at(total, parents, counts)
            np.add.at(distinct, parents, counts > 0)
            escape = np.where(total > 0, -np.log2(np.maximum(distinct, 1) / np.maximum(total + distinct, 1)), 0.0)
            escape[0] = 0
            lower = cost[suffix_of]
            cost = np.where(counts > 0, -np.log2(np.maximum(counts, 1) / np.maximum(total + distinct, 1)[parents]), escape[parents] + lower)
            self.tables.append(table)
            self.escapes.append(escape.astype(np.float32))
            self.costs.append(cost.astype(np.float32))
            place = new

    def lengths(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text (a row) in each language (a column)."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        step = max(1, _PIECE * 4 // max(4, len(self.languages)))
        head = np.zeros(len(buf) + 1, bool)
        head[offsets[:-1]] = True
        owner = np.repeat(np.arange(len(out)), np.diff(offsets))
        for lo in range(0, len(buf), step):
            back = max(0, lo - self.order)  # the bytes before give the context of the first ones
            bits = self._bits(buf[back : lo + step], head[back : lo + step])[lo - back :]
            own = owner[lo : lo + step]
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)
        return out

    def _bits(self, line: np.ndarray, head: np.ndarray) -> np.ndarray:
        symbols = self.symbol[line]
        places, before = [symbols], []
        for table in self.tables:
            prior = np.concatenate([[0], places[-1][:-1]])
            prior[head[: len(line)]] = 0
            before.append(prior)
            places.append(table[prior, symbols].astype(np.int64))
        # From the longest context down: bytes known there are paid for, the others pay the escape and go on.
        bits = self.costs[self.order][places[self.order]]
        left = np.flatnonzero(places[self.order] == 0) if self.order else np.empty(0, np.int64)
        bits[left] = 0
        for k in range(self.order - 1, -1, -1):
            if not len(left):
                break
            bits[left] += self.escapes[k][before[k][left]]
            known = places[k][left] > 0 if k else np.ones(len(left), bool)
            bits[left[known]] += self.costs[k][places[k][left[known]]]
            left = left[~known]
        return bits


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> Trees | None:
    """Trees of the languages labelled outside the held-out part, from about ``sample_texts`` distinct texts of each.

    Texts are chosen by their hash, at a rate that follows from the language's number of distinct texts, and copies of a
    text count once; they are whole texts. The text of the least hash is always chosen, so that every language has one;
    of the others as many as have ``sample_bytes`` with it.
    """
    known = only(docs, "doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.filter(F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("hash"))
    place = F.pmod("hash", F.lit(1 << 20))
    told = known.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min(F.struct(place, "hash")).alias("first")).collect()
    if not told:
        return None
    of = lambda values: F.try_element_at(F.create_map(*[F.lit(x) for pair in values for x in pair]), F.col("lang"))
    rate = of([(r["lang"], min(1.0, sample_texts / r["n"])) for r in told])
    chosen = known.filter((place < rate * (1 << 20)) | (F.col("hash") == of([(r["lang"], r["first"]["hash"]) for r in told])))
    scratch = Scratch(docs.sparkSession, "langid")
    chosen = scratch.table(chosen.dropDuplicates(["lang", "hash"]).withColumn("size", F.octet_length("text")), "chosen")
    # The bytes that reach the driver are bounded too: texts in the order of their hashes, as far as they go.
    wanted, held = [], {}
    for row in chosen.select("lang", "hash", "size").orderBy("lang", place, "hash").collect():
        held.setdefault(row["lang"], 0)
        if not held[row["lang"]] or held[row["lang"]] + row["size"] <= sample_bytes:
            held[row["lang"]] += max(1, row["size"])
            wanted.append((row["lang"], row["hash"]))
    some = docs.sparkSession.createDataFrame(wanted, "lang string, hash bigint")
    samples: dict[str, list[bytes]] = {}
    for row in chosen.join(F.broadcast(some), ["lang", "hash"]).select("lang", "text").collect():
        samples.setdefault(row["lang"], []).append(row["text"].encode())
    scratch.close()
    return Trees({lang: sorted(texts) for lang, texts in samples.items()}, order) if samples else None


def with_letters(column: pa.Array, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_ASCII_LETTER[buf], out=sums[1:])
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = bool(_LETTER.search(column[int(i)].as_py()))
    return out


def language(docs: DataFrame, trees: Trees | None = None, sample_texts: int = SAMPLE_TEXTS, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, lang_pred, and the prediction's share of all languages' probabilities."""
    trees = trees or learn(docs, sample_texts, order)
    if trees is None:
        return only(docs, "doc_id").select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for a, b in ts.pieces(batch.column(2)):
                part = batch.slice(a, b - a)
                column = part.column(2)
                buf, offsets = ts.texts(column)
                bits = own.lengths(buf, offsets)
                best = bits.argmin(axis=1)
                score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                letters = with_letters(column, buf, offsets)
                names = [own.languages[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return only(docs, "doc_id", "text").select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text")).mapInArrow(predict, SCHEMA)
