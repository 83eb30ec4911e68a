"""Personal data: fixed patterns first, then bootstrapped contextual extraction.

What the fixed patterns find are the seeds. The two words before a seed are a lexical pattern, and so are the two after
it; the same words around other identifiers tie that pattern to further instances. Spark scores the resulting graph of
patterns and instances round by round: a pattern is trusted as far as the distinct instances it surrounds are known
ones, an instance as far as trusted patterns surround it, and trusted instances count as known in the next round.

Instances in the graph are seeds, tokens of four or more characters with two digits or more, and runs of numbers with
brackets, hyphens and spaces between them. Names, handles and spelled-out addresses have no such shape. They are looked
for in a second pass, under the patterns that the graph ends up trusting and nowhere else: the distinct words that such a
pattern surrounds are counted against it, and where it still is trusted, and more strictly, they are found too. What trusted
patterns surround and no fixed pattern covers are the method's own spans, of kind ``context``.

Cases: a null text counts as empty; an empty text has no spans and the hash of the empty string; repeated rows each get
their row, and rows that share a doc_id keep to their own texts' spans; an empty table gives an empty result; extra
columns are not read, and ``redact`` passes them on.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlode.llm import textscan as ts
from findlode.llm.shared import Scratch, if_few, only, unnamed

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs this many distinct known instances before it is trusted at all, and this share of its instances known.
MIN_KNOWN = 5
MIN_TRUST = 0.8
#: For words of any shape.
MIN_TRUST_ANY = 0.95
ROUNDS = 3
#: Places of the filter that says which pairs of words may be trusted patterns; those that pass are then joined exactly.
FILTER = 1 << 20

#: The contract's patterns, written so that no text makes them backtrack more than linearly.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_WHITE = "\t\n\v\f\r "
_EDGE = ".,;:!?[]{}<>\"'"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: More of a number after a space: digits with brackets and the like between them.
_MORE = re.compile(r"\x20([0-9(][0-9().+/-]*)(?![^\x20\x09-\x0D.,;:!?])")
_NUMERIC = re.compile(r"[0-9().+/-]*[0-9)]")
#: A spelled-out address.
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]+(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]+)+", re.IGNORECASE)
#: Factors of the first and the second word, and of the side, in a pattern's hash.
_FIRST, _SECOND, _SIDE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ is looked at once: the run of name characters before it, as far as the last match's end, and the domain after it."""
    end = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield begin, end
            at = text.find("@", end)
        else:
            end = max(end, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of everything the fixed patterns find, by start, then kind."""
    found = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:].lstrip("0") or 0) <= 255 for x in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = (*KINDS, "context")) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in spans)


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without outer punctuation; a bracket stays if its other half is within."""
    close, opened = text.rfind(")", a, b), text.find("(", a, b)
    while a < b and (text[a] in _EDGE or text[a] == ")" or (text[a] == "(" and close < a)):
        a += 1
    while a < b and (text[b - 1] in _EDGE or text[b - 1] == "(" or (text[b - 1] == ")" and not a <= opened < b)):
        b -= 1
    return a, b


def _identifiers(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with digits, and runs of numbers, that no span covers."""
    k, m = 0, _DIGIT.search(text)
    while m:
        a, b = m.start(), m.end()
        while a and text[a - 1] not in _WHITE:
            a -= 1
        b = _WORD.match(text, a).end()
        if _NUMERIC.fullmatch(text, a, b):
            while (more := _MORE.match(text, b)) and _DIGIT.search(more[1]):
                b = more.end()
        after = b
        a, b = _trimmed(text, a, b)
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        covered = any(x < b and a < y for x, y, _ in spans[k : k + 8])
        if b - a >= 4 and not covered and len(_DIGITS.sub("", text[a:b])) >= 2:
            yield a, b
        m = _DIGIT.search(text, after)


def _words_before(text: str, a: int, stop: int) -> tuple[str, str] | None:
    """The two words between ``stop`` and a place, whole, if there are two and none has a digit."""
    found = []
    while len(found) < 2:
        while a > stop and text[a - 1] in _WHITE:
            a -= 1
        b = a
        while a > stop and text[a - 1] not in _WHITE:
            a -= 1
        if a == b or (a == stop and a and text[a - 1] not in _WHITE) or _DIGIT.search(text, a, b):
            return None
        found.append(text[a:b])
    return found[1], found[0]


def _words_after(text: str, b: int, stop: int) -> tuple[str, str] | None:
    m = _WORD.search(text, b, stop)
    if m and m.start() == b:  # what is left of the token itself, such as a comma
        m = _WORD.search(text, m.end(), stop)
    n = m and _WORD.search(text, m.end(), stop)
    if not n or (n.end() == stop < len(text) and text[stop] not in _WHITE) or _DIGIT.search(text, m.start(), n.end()):
        return None
    return m[0], n[0]


def _hashed(words: list[str], lower: bool = True) -> np.ndarray:
    buf, offsets = ts.texts(pa.array(words, pa.string()))
    return ts.span_hashes(ts.LOWER[buf] if lower else buf, offsets[:-1], offsets[1:])


def _patterns(first: np.ndarray, second: np.ndarray, side: np.ndarray | int) -> np.ndarray:
    """The hash of two words on a side (0 before, 1 after)."""
    return ts.mix(first * _FIRST + second * _SECOND + np.asarray(side, np.uint64) * _SIDE).view(np.int64)


class _Spans:
    """Spans of a text, asked one by one in constant or logarithmic time."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.spans = sorted(spans)
        self.starts = [a for a, _ in self.spans]
        self.reach = list(itertools.accumulate((b for _, b in self.spans), max))

    def meets(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b)
        return k > 0 and self.reach[k - 1] > a

    def around(self, a: int, b: int) -> tuple[int, int] | None:
        k = bisect.bisect_right(self.starts, a) - 1
        return self.spans[k] if k >= 0 and self.spans[k][1] >= b else None


Mark = tuple[int, int, int, tuple[str, str], str, bool]


def _contexts(text: str, spans: list[tuple[int, int, int]]) -> list[Mark]:
    """(start, end, side, words, instance, known) of seeds and identifiers under the words before and after them."""
    marks = sorted([(a, b, True) for a, b, _ in spans] + [(a, b, False) for a, b in _identifiers(text, spans)])
    out, before, starts = [], 0, [a for a, _, _ in marks]
    for a, b, known in marks:
        # Words are looked for between one mark and the next, so that a text is walked through once.
        at = bisect.bisect_left(starts, b)
        after = starts[at] if at < len(starts) else len(text)
        for side, words in ((0, _words_before(text, a, min(a, before))), (1, _words_after(text, b, after))):
            if words:
                out.append((a, b, side, words, text[a:b], known))
        before = max(before, b)
    return out


FOUND = "doc_id bigint, hash bigint, spans array<struct<s:int,e:int,k:int>>, marks array<struct<s:int,e:int,pattern:bigint,instance:bigint,known:boolean>>"


def _rows(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("hash"))


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: its base spans, and its marks for the graph. One pass over the texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("k", pa.int32())]))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        for batch in batches:
            for lo, hi in ts.pieces(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                spans, marks, ends = [], [], [0]
                for text in part.column(1).to_pylist():
                    own = base_spans(text or "")
                    spans.append([{"s": a, "e": b, "k": k} for a, b, k in own])
                    marks += _contexts(text or "", own)
                    ends.append(len(marks))
                first, second = (_hashed([m[3][i] for m in marks]) for i in (0, 1))
                columns = ([m[0] for m in marks], [m[1] for m in marks], _patterns(first, second, np.array([m[2] for m in marks], np.uint64)), _hashed([m[4] for m in marks], lower=False).view(np.int64), [m[5] for m in marks])
                rows = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["s", "e", "pattern", "instance", "known"])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(spans, spans_of), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], names=["doc_id", "hash", "spans", "marks"])

    return _rows(docs).mapInArrow(find, FOUND)


OTHERS = "doc_id bigint, hash bigint, s int, e int, pattern bigint, instance bigint"


def others(docs: DataFrame, patterns: DataFrame, min_trust: float = MIN_TRUST) -> DataFrame:
    """(doc_id, hash, s, e, pattern, instance): the words of any other shape that the patterns surround. One pass.

    A pattern stays trusted only while no more distinct words turn up than its known instances have room for. A task that
    has seen more knows that the pattern is lost, and says no more of it: what it has said by then is proof enough.
    Patterns that stay trusted are reported whole. A filter of fixed size goes to the tasks, and what passes it is joined
    with the patterns themselves.
    """
    rooms = patterns.select(F.pmod("pattern", F.lit(FILTER)).cast("int").alias("place"), F.floor(F.col("known") / min_trust - F.col("n") + 1).cast("int").alias("room")).groupBy("place").agg(F.max("room").alias("room")).toArrow()
    room_of = np.full(FILTER, -1, np.int32)
    room_of[rooms.column("place").to_numpy()] = rooms.column("room").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(room_of)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room_of = shared.value
        seen: dict[int, set[int]] = {}
        lost = np.empty(0, np.int64)
        for batch in batches:
            for lo, hi in ts.pieces(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                buf, offsets = ts.texts(part.column(1))
                starts, ends, hashes, first = ts.words_of(buf, offsets)
                owner = np.repeat(np.arange(hi - lo), np.diff(first))
                hits = []
                for side, (x, y) in enumerate(((-2, -1), (1, 2))):  # where the pattern's words lie, seen from the instance
                    at = np.arange(max(0, -x), len(hashes) - max(0, y))
                    at = at[owner[at + x] == owner[at + y]]
                    at = at[owner[at] == owner[at + y]]
                    pattern = _patterns(hashes[at + x], hashes[at + y], side)
                    some = room_of[pattern % FILTER] >= 0
                    some[some] = ~np.isin(pattern[some], lost)
                    hits += zip(at[some].tolist(), pattern[some].tolist(), strict=True)
                rows, done, full = [], {}, set()
                for i, pattern in sorted(hits):
                    if pattern in full:
                        continue
                    k = int(owner[i])
                    if k not in done:
                        text = part.column(1)[k].as_py()
                        spans = base_spans(text)
                        done[k] = [text, _Spans([(a, b) for a, b, _ in spans] + list(_identifiers(text, spans))), _Spans([m.span() for m in _SPELLED.finditer(text)]), int(offsets[k]), 0]
                    text, covered, spelled, at, chars = done[k]
                    a = chars + len(buf[at : starts[i]].tobytes().decode())
                    done[k][3:] = int(starts[i]), a
                    a, b = _trimmed(text, a, a + len(buf[starts[i] : ends[i]].tobytes().decode()))
                    a, b = spelled.around(a, b) or (a, b)
                    if a < b and not covered.meets(a, b):
                        rows.append((k, a, b, pattern, instance := xxhash.xxh64_intdigest(text[a:b].encode()) - (1 << 63)))
                        words = seen.setdefault(pattern, set())
                        words.add(instance)
                        if len(words) > room_of[pattern % FILTER]:
                            full.add(pattern)
                            del seen[pattern]
                lost = np.concatenate([lost, np.array(sorted(full), np.int64)])
                if rows:
                    k, a, b, pattern, words = (list(x) for x in zip(*rows, strict=True))
                    own = part.take(pa.array(k))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(pattern, pa.int64()), pa.array(words, pa.int64())], names=[f.split()[0] for f in OTHERS.split(", ")])

    return _rows(docs).filter("text is not null").mapInArrow(find, OTHERS).join(if_few(patterns.select("pattern")), "pattern", "left_semi").select(*[f.split()[0] for f in OTHERS.split(", ")])


def trusted_patterns(found: DataFrame, scratch: Scratch, min_known: int = MIN_KNOWN, min_trust: float = MIN_TRUST, rounds: int = ROUNDS) -> DataFrame:
    """The patterns that the graph ends up trusting.

    The graph has an edge for each distinct (pattern, instance); patterns that surround fewer than ``min_known``
    distinct instances can never be trusted and are left out, which keeps it far smaller than the corpus.
    """
    edges = found.select(F.explode("marks").alias("m")).select("m.pattern", "m.instance", "m.known").groupBy("pattern", "instance").agg(F.max("known").alias("known"))
    edges = scratch.table(edges, "edges")
    broad = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= min_known).drop("n")
    graph = scratch.table(edges.join(broad, "pattern", "left_semi"), "graph0")
    patterns = None
    for i in range(rounds):
        patterns = scratch.table(
            graph.groupBy("pattern").agg(F.sum(F.col("known").cast("int")).alias("known"), F.count("*").alias("n")).filter((F.col("known") >= min_known) & (F.col("known") >= min_trust * F.col("n"))).select("pattern", "known", "n", (F.col("known") / F.col("n")).alias("trust")),
            f"patterns{i}",
        )
        if i + 1 == rounds:
            break
        # An instance's trust is that of its patterns taken as independent witnesses; a known one keeps its own.
        fresh = graph.filter(~F.col("known")).join(patterns, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.lit(1.0001) - F.col("trust"))))).alias("trust")).filter(F.col("trust") >= min_trust).select("instance", F.lit(True).alias("fresh"))
        fresh = scratch.table(fresh, f"fresh{i}")
        if fresh.isEmpty():
            break
        graph = scratch.table(graph.join(fresh, "instance", "left").select("pattern", "instance", (F.col("known") | F.coalesce("fresh", F.lit(False))).alias("known")), f"graph{i + 1}")
    return patterns


def added_spans(docs: DataFrame, found: DataFrame, scratch: Scratch, min_known: int, min_trust: float, rounds: int) -> DataFrame:
    """(doc_id, hash, added): what trusted patterns surround and no fixed pattern covers."""
    patterns = trusted_patterns(found, scratch, min_known, min_trust, rounds)
    rest = scratch.table(others(docs, patterns, min_trust), "others")
    # All that a pattern surrounds counts against it now.
    more = rest.select("pattern", "instance").distinct().groupBy("pattern").agg(F.count("*").alias("more"))
    share = F.col("known") / (F.col("n") + F.coalesce("more", F.lit(0)))
    patterns = scratch.table(patterns.join(more, "pattern", "left").select("pattern", share.alias("trust")).filter(F.col("trust") >= min_trust), "patterns")
    marks = found.select("doc_id", "hash", F.explode("marks").alias("m")).filter(~F.col("m.known")).select("doc_id", "hash", "m.s", "m.e", "m.pattern")
    hits = marks.join(if_few(patterns.select("pattern")), "pattern", "left_semi")
    strict = patterns.filter(F.col("trust") >= max(min_trust, MIN_TRUST_ANY)).select("pattern")
    hits = hits.unionByName(rest.join(if_few(strict), "pattern", "left_semi").select("pattern", "doc_id", "hash", "s", "e")).drop("pattern").distinct()
    return hits.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list(F.struct("s", "e", F.lit(len(KINDS)).alias("k")))).alias("added"))


def _same(doc_id: str, text_hash: str) -> Column:
    return F.col(doc_id).eqNullSafe(F.col("added_for")) & (F.col(text_hash) == F.col("added_hash"))


def personal_data(docs: DataFrame, min_known: int = MIN_KNOWN, min_trust: float = MIN_TRUST, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, a count per kind, n_context, base_sha256 and spans."""
    scratch = Scratch(docs.sparkSession, "privacy")
    found = scratch.table(scan(docs), "found")
    added = scratch.table(added_spans(docs, found, scratch, min_known, min_trust, rounds), "added")
    # Few documents have added spans; for the others nothing is joined but a null.
    both = found.select("doc_id", "hash", "spans").join(if_few(added.withColumnsRenamed({"doc_id": "added_for", "hash": "added_hash"})), _same("doc_id", "hash"), "left")
    empty = F.expr("cast(array() as array<struct<s:int,e:int,k:int>>)")
    every = F.array_sort(F.concat("spans", F.coalesce("added", empty)), lambda a, b: F.when(a.s != b.s, a.s - b.s).otherwise(a.k - b.k))
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "context")])
    number = lambda n: F.size(F.filter("spans", lambda x: x.k == n)).cast("bigint")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x.k), x.s, x.e)), ",")
    out = both.select("doc_id", *[number(n).alias(f"n_{k}") for n, k in enumerate(KINDS)], F.coalesce(F.size("added"), F.lit(0)).cast("bigint").alias("n_context"), F.sha2(text(F.col("spans")), 256).alias("base_sha256"), text(every).alias("spans"))
    return scratch.result(out)


def redact(docs: DataFrame, min_known: int = MIN_KNOWN, min_trust: float = MIN_TRUST, rounds: int = ROUNDS) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets, and n_chars, where there is one, made new."""
    scratch = Scratch(docs.sparkSession, "privacy")
    found = scratch.table(scan(docs).filter(F.size("marks") > 0), "found")
    added = scratch.result(added_spans(docs, found, scratch, min_known, min_trust, rounds))
    names = docs.columns
    where, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ts.pieces(batch.column(where)):
                part = batch.slice(lo, hi - lo)
                out = []
                for text, extra in zip(part.column(where).to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                    if text:
                        spans = sorted(base_spans(text) + [(x["s"], x["e"], x["k"]) for x in extra or ()])
                        kept, at = [], 0
                        for a, b, k in spans:
                            if a >= at:
                                kept += [text[at:a], f"<{(*KINDS, 'context')[k].upper()}>"]
                            at = max(at, b)
                        text = "".join([*kept, text[at:]]) if spans else text
                    out.append(text)
                columns = list(part.columns[: len(names)])
                columns[where] = pa.array(out, pa.string())
                if count is not None:
                    columns[count] = pa.array([None if x is None else len(x) for x in out], pa.int64()).cast(columns[count].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    own = unnamed(docs).withColumn("own_hash", F.xxhash64(f"_{where}"))
    own = own.join(if_few(added.withColumnsRenamed({"doc_id": "added_for", "hash": "added_hash"})), _same(f"_{names.index('doc_id')}", "own_hash"), "left")
    return own.select(*[f"_{i}" for i in range(len(names))], "added").mapInArrow(replace, docs.schema)
