"""Quality classifier by co-training over two views.

One view sees a text's content: its distinct words, and bands of its figures (symbols, repeats, lines, word lengths).
The other sees the page's metadata: language, source, bands of its length, and pairs of these. Both start from labelled
documents. In each round each view scores all unlabelled documents, and the ``HANDED`` of either class that it is surest
of become training documents of the other view. A view is sure by its own measure: its scores are calibrated on labelled
documents kept aside, with both classes counting the same, and a document is handed on with the weight abs(2p - 1).
Copies of a text are handed on once.
After the last round the views are calibrated again and combined with weights that are never negative, and all
documents are scored.

Fitting uses a bounded sample of labelled documents: those of the least hashes of their id, ``LABELLED`` at most, and
``KEYS`` keys in all at most. All unlabelled documents are asked in every round. Keys are hashed to ``WIDTH`` places.

Cases: a null text counts as empty; null metadata is a value of its own; labels that are null or contradict each other
are left out; without labels of both kinds every score is 0.5; of rows that share a doc_id the one of the least text hash
is learned from, and each gets its score; a null doc_id is scored and never learned from; empty tables give an empty
result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlode.llm import textscan as ts
from findlode.llm.quality import Texts
from findlode.llm.shared import Scratch, if_few, only

LABELLED = 4000
#: Keys of all documents that are learned from at once, at most.
KEYS = 1 << 22
ROUNDS = 2
#: Per round and class, each view hands on so many documents.
HANDED = 100
WIDTH = 1 << 18
SCHEMA = "doc_id bigint, p_content double, p_metadata double, score double, kept boolean"


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _band(values: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), values, "right")


def figures(t: Texts) -> list[np.ndarray]:
    """Bands of a text's figures, each a small number per text."""
    n = np.maximum(t.n_words, 1)
    shares = [0.001, 0.01, 0.03, 0.1, 0.2, 0.3, 0.5, 0.8]
    return [
        _band(t.figure("n_symbols") / n, shares),
        _band(t.figure("n_repeat_words") / n, shares),
        _band(t.figure("n_dup_lines") / np.maximum(t.figure("n_lines"), 1), shares),
        _band(t.figure("word_chars") / n, [2, 3, 4, 5, 6, 7, 8, 10, 15]),
        _band(t.figure("commonest") / n, [0.02, 0.05, 0.1, 0.2, 0.3, 0.5]),
        _band(t.n_words, [5, 10, 20, 50, 100, 1000]),
    ]


Rows = tuple[np.ndarray, np.ndarray]  # the number of a text and a place, for each of its keys


def _placed(owner: np.ndarray, keys: np.ndarray) -> Rows:
    """The distinct places of each text's keys, in order."""
    both = np.unique((owner.astype(np.int64) << np.int64(32)) | (keys >> np.uint64(32)).astype(np.int64) % WIDTH)
    return both >> 32, both & 0xFFFFFFFF


def content_keys(t: Texts) -> Rows:
    bands = [ts.mix((np.uint64(1 + k) << np.uint64(32)) + b.astype(np.uint64)) for k, b in enumerate(figures(t))]
    return _placed(np.concatenate([t.owner, *[t.rows] * len(bands)]), np.concatenate([t.hashes, *bands]))


def metadata_keys(lang: list, source: list, n_chars: list) -> Rows:
    keys, owner = [], []
    for row, (a, b, c) in enumerate(zip(lang, source, n_chars, strict=True)):
        size = int(c).bit_length() if c is not None else None
        fine = int(2 * np.log2(1 + max(int(c), 0))) if c is not None else None
        own = (f"lang={a}", f"source={b}", f"size={size}", f"fine={fine}", f"lang={a} source={b}", f"lang={a} size={size}", f"source={b} size={size}")
        keys += own
        owner += [row] * len(own)
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    buf, offsets = ts.texts(pa.array(keys))
    return _placed(np.array(owner), ts.span_hashes(buf, offsets[:-1], offsets[1:]))


@dataclass
class View:
    """A logistic model over the places; a text's sum of weights is divided by the root of its number of keys."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    bias: float = 0.0

    def logits(self, rows: Rows, n: int) -> np.ndarray:
        owner, place = rows
        scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
        return np.bincount(owner, self.weights[place], n) * scale + self.bias

    def fit(self, rows: Rows, y: np.ndarray, weight: np.ndarray, steps: int = 150, penalty: float = 1e-4) -> None:
        """Adam on the weighted logistic loss, from where the model stands. Only places that occur are moved."""
        n = len(y)
        owner, place = rows
        used, place = np.unique(place, return_inverse=True)
        scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
        w, b = self.weights[used], self.bias
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        total = max(weight.sum(), 1e-9)
        for k in range(1, steps + 1):
            z = np.bincount(owner, w[place], n) * scale + b
            error = (sigmoid(z) - y) * weight / total
            slope = np.append(np.bincount(place, (error * scale)[owner], len(w)) + penalty * w, error.sum())
            m = 0.9 * m + 0.1 * slope
            v = 0.999 * v + 0.001 * slope * slope
            move = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        self.weights[used], self.bias = w, float(b)


Line = tuple[float, float]


@dataclass
class Model:
    views: tuple[View, View]
    calibration: tuple[Line, Line]
    mixture: tuple[float, float, float]
    #: (round, giving view, class, documents) of every hand-over.
    handed: list[tuple[int, int, int, int]] = field(default_factory=list)

    def scores(self, logits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = [a * x + b for (a, b), x in zip(self.calibration, logits, strict=True)]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(self.mixture[0] * z[0] + self.mixture[1] * z[1] + self.mixture[2])


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights that make both classes count the same."""
    ones = max(y.sum(), 1)
    return np.where(y > 0, 0.5 / ones, 0.5 / max(len(y) - y.sum(), 1)) * len(y)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Coefficients, none of them negative, and intercept of a small ridge-stabilised logistic regression.

    Newton's method; a coefficient that comes out negative is set to 0 and the others are found again.
    """
    weight = np.ones(len(y)) if weight is None else weight
    use = np.ones(x.shape[1], bool)
    while True:
        own = np.c_[x[:, use], np.ones(len(y))]
        c = np.zeros(own.shape[1])
        for _ in range(30):
            p = sigmoid(own @ c)
            h = (own * (weight * p * (1 - p))[:, None]).T @ own + 1e-2 * np.eye(len(c))
            move = np.clip(np.linalg.solve(h, own.T @ (weight * (y - p)) - 1e-2 * c), -2, 2)
            c += move
            if np.abs(move).max() < 1e-6:
                break
        if (c[:-1] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[:-1][use], out[-1] = c[:-1], c[-1]
            return out
        use[np.flatnonzero(use)[np.argmin(c[:-1])]] = False


def line(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Line:
    c = logistic(z[:, None], y, weight)
    return float(c[0]), float(c[1])


@dataclass
class Sample:
    """Documents that are learned from: their ids, labels, weights, and keys in both views."""

    ids: list[int]
    y: np.ndarray
    weight: np.ndarray
    keys: tuple[Rows, Rows]

    @staticmethod
    def of(rows: list[tuple[int, float, float, list[int], list[int]]]) -> Sample:
        """From (doc_id, label, weight, content places, metadata places)."""
        def flat(k: int) -> Rows:
            return np.repeat(np.arange(len(rows)), [len(r[k]) for r in rows]), np.concatenate([np.empty(0, np.int64), *[np.asarray(r[k], np.int64) for r in rows]])

        return Sample([r[0] for r in rows], np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float), (flat(3), flat(4)))


def parted(rows: list) -> tuple[list, list]:
    """The rows to train on, and every fifth, which is kept aside for calibration."""
    return [r for i, r in enumerate(rows) if i % 5], rows[::5]


def train(view: View, k: int, own: Sample) -> None:
    view.fit(own.keys[k], own.y, balanced(own.y) * own.weight)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), and the places of the keys of both views. One pass over the texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(rows: Rows, n: int) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[0], np.arange(n + 1)).astype(np.int32)), pa.array(rows[1].astype(np.int32)))

        for batch in batches:
            for a, b in ts.pieces(batch.column(1)):
                part = batch.slice(a, b - a)
                meta = metadata_keys(*[part.column(i).to_pylist() for i in (2, 3, 4)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(5), lists(content_keys(Texts(part.column(1))), b - a), lists(meta, b - a)], names=["doc_id", "hash", "content", "meta"])

    rows = only(docs, "doc_id", "text", "lang", "source", "n_chars").select(F.col("doc_id").cast("bigint"), "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("bigint"), F.xxhash64("text").alias("hash"))
    return rows.mapInArrow(find, "doc_id bigint, hash bigint, content array<int>, meta array<int>")


def _rows_of(batch: pa.RecordBatch, name: str) -> Rows:
    column = batch.column(batch.schema.get_field_index(name))
    return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False)), column.flatten().to_numpy(zero_copy_only=False)


def candidates(keys: DataFrame, views: tuple[View, View], most: int) -> DataFrame:
    """(view, side, doc_id, hash, z): for each view and class the surest documents of every task, ``most`` at most.

    Copies of a text count once. A task holds these lists alone, however many documents it reads.
    """
    shared = keys.sparkSession.sparkContext.broadcast(views)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {(i, side): (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)) for i in (0, 1) for side in (0, 1)}
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy() for i in (0, 1))
            for i, (view, name) in enumerate(zip(shared.value, ("content", "meta"), strict=True)):
                z = view.logits(_rows_of(batch, name), len(batch))
                for side in (0, 1):
                    d, h, x = (np.concatenate(pair) for pair in zip(best[i, side], (ids, hashes, z), strict=True))
                    turn = np.lexsort((ts.mix(d.view(np.uint64)), -x if side else x))
                    turn = turn[np.sort(np.unique(h[turn], return_index=True)[1])[:most]]
                    best[i, side] = (d[turn], h[turn], x[turn])
        for (i, side), (d, h, x) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), i, np.int32)), pa.array(np.full(len(d), side, np.int32)), pa.array(d), pa.array(h), pa.array(x)], names=["view", "side", "doc_id", "hash", "z"])

    return keys.select("doc_id", "hash", "content", "meta").mapInArrow(score, "view int, side int, doc_id bigint, hash bigint, z double")


def _collected(keys: DataFrame, wanted: dict[int, tuple[float, float]]) -> list[tuple[int, float, float, list[int], list[int]]]:
    """The keys of the documents asked for, of which there are few, with their labels and weights, by the hash of the id."""
    if not wanted:
        return []
    ids = keys.sparkSession.createDataFrame([(d,) for d in wanted], "doc_id bigint")
    found = keys.join(F.broadcast(ids), "doc_id").withColumn("size", F.size("content"))
    order = (F.xxhash64("doc_id", F.lit(17)), F.col("doc_id"))
    sizes = found.groupBy("doc_id").agg(F.min_by("size", "hash").alias("size")).orderBy(*order).collect()
    held = np.cumsum([r["size"] for r in sizes]) <= KEYS
    some = {r["doc_id"]: i for i, r in enumerate(sizes) if held[i]}
    if not some:
        return []
    ids = keys.sparkSession.createDataFrame([(d,) for d in some], "doc_id bigint")
    rows = keys.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("content", "meta"), "hash").alias("k")).collect()
    return [(r["doc_id"], *wanted[r["doc_id"]], r["k"]["content"], r["k"]["meta"]) for r in sorted(rows, key=lambda r: some[r["doc_id"]])]


def surest(found: DataFrame, view: int, slope: Line, side: int, most: int) -> dict[int, tuple[float, float]]:
    """{doc_id: (label, weight)} of the documents that a view is surest of, if it takes them for that class at all."""
    own = found.filter((F.col("view") == view) & (F.col("side") == side)).withColumn("place", F.struct(F.col("z") * (-1 if side else 1), F.xxhash64("doc_id", F.lit(29)), "doc_id"))
    top = own.groupBy("hash").agg(F.min("place").alias("place"), F.min_by("doc_id", "place").alias("doc_id"), F.min_by("z", "place").alias("z")).orderBy("place").limit(most).collect()
    p = sigmoid(np.array([slope[0] * r["z"] + slope[1] for r in top]))
    return {r["doc_id"]: (float(side), abs(2 * x - 1)) for r, x in zip(top, p.tolist(), strict=True) if (x > 0.5 if side else x < 0.5)}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS, handed: int = HANDED, scratch: Scratch | None = None, keys: DataFrame | None = None) -> Model | None:
    """The model; only the keys of documents that are learned from reach the driver."""
    own_scratch = scratch is None
    scratch = scratch or Scratch(docs.sparkSession, "cotrain")
    known = only(labels, "doc_id", label).filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2")).filter("y = y2").select(F.col("doc_id").cast("bigint"), F.col("y").cast("double"))
    known = scratch.table(known, "known")
    keys = scratch.table(keyed(docs), "keys") if keys is None else keys
    try:
        there = known.join(keys.select("doc_id").distinct(), "doc_id", "left_semi")
        chosen = there.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(labelled).collect()
        rows, aside = parted(_collected(keys, {r["doc_id"]: (r["y"], 1.0) for r in chosen}))
        if len({r[1] for r in rows}) < 2 or len({r[1] for r in aside}) < 2:
            return None
        told: list[list] = [list(rows), list(rows)]
        kept = Sample.of(aside)
        views, log = (View(), View()), []
        for k in range(rounds + 1):
            for i, view in enumerate(views):
                train(view, i, Sample.of(told[i]))
            z = [view.logits(kept.keys[i], len(kept.ids)) for i, view in enumerate(views)]
            if k == rounds:
                break
            pool = keys.filter("doc_id is not null").join(if_few(known.select("doc_id")), "doc_id", "left_anti")
            scores = scratch.table(candidates(pool, views, handed * (k + 1)), f"scores{k}")
            for i in (0, 1):
                slope, other = line(z[i], kept.y, balanced(kept.y)), told[1 - i]
                before = {r[0] for r in other}
                found: dict[int, tuple[float, float]] = {}
                for side in (1, 0):
                    some = {d: w for d, w in surest(scores, i, slope, side, handed * (k + 1)).items() if d not in before}
                    found.update(list(some.items())[:handed])
                    log.append((k, i, side, len(found) if side else len(found) - log[-1][3]))
                other += _collected(keys, found)
        lines = [line(x, kept.y) for x in z]
        mixed = logistic(np.stack([a * x + b for (a, b), x in zip(lines, z, strict=True)], axis=1), kept.y)
        return Model(views, (lines[0], lines[1]), tuple(float(x) for x in mixed), log)
    finally:
        if own_scratch:
            scratch.close()


def quality_scores(docs: DataFrame, labels: DataFrame, model: Model | None = None, label: str = "quality") -> DataFrame:
    """Every document's probability of being good, by each view and by both. The texts are read once, no shuffle."""
    scratch = Scratch(docs.sparkSession, "cotrain")
    keys = scratch.table(keyed(docs), "keys")
    model = model or fit(docs, labels, label, scratch=scratch, keys=keys)
    if model is None:
        half = [F.lit(0.5).alias(c) for c in ("p_content", "p_metadata", "score")]
        return scratch.result(keys.select("doc_id", *half, F.lit(True).alias("kept")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            p = own.scores([view.logits(_rows_of(batch, name), len(batch)) for view, name in zip(own.views, ("content", "meta"), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p), pa.array(p[2] >= 0.5)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return scratch.result(keys.select("doc_id", "content", "meta").mapInArrow(score, SCHEMA))
