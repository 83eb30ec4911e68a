"""Secrets, told from widely copied examples by who owns them. DataFrame operations only.

Three fixed patterns find base spans. Beside them, every token of twenty or more key-like characters with a digit, a
small and a capital letter is a candidate. The values of both are hashed, and the hashes are counted over the whole
corpus by distinct repositories and distinct owners. A value that more than ``max_owners`` of either share is a copied
example, as found in manuals; another is owner-specific and looks live. Owner-specific candidates become spans of kind
``owned``; base spans stay whatever their values' counts.

Counts are taken over distinct (value, repository, owner) first, so that a value copied a million times is a handful of
rows before it is shuffled by its hash. Only copied values are joined back, as a broadcast where they are counted as few.

Cases: a null text counts as empty; an empty text has no spans and the hash of the empty string; a null repository or
owner is no owner; repeated rows each get their row; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlode.llm.shared import Scratch, if_few, only

KINDS = ("assign", "access", "hex", "owned")
MAX_OWNERS = 2

#: The contract's patterns. A run of one class that is long enough is that class's maximal run.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"

#: Running values are found in blocks of this size, which keeps a text of a million matches from quadratic work.
_BLOCK = 512
_NONE = "cast(array() as array<struct<s:int,k:int,e:int,v:string>>)"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(values: Column, first: int, op: Callable[[Column, Column], Column]) -> Column:
    """The running values of ``op`` over a short array."""
    start = F.struct(F.lit(first).alias("now"), F.expr("cast(array() as array<int>)").alias("all"))
    step = lambda acc, x: _once(op(acc["now"], x), lambda y: F.struct(y.alias("now"), F.concat(acc["all"], F.array(y)).alias("all")))
    return F.aggregate(values, start, step, lambda acc: acc["all"])


def running(values: Column, first: int, op: Callable[[Column, Column], Column]) -> Column:
    """The running values of an associative ``op`` over an array of integers that has values; ``first`` is neutral to it.

    A block is folded by itself, then the blocks' last values are, and each block is moved on by what comes before it.
    """

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: _fold(F.slice(v, b * _BLOCK + 1, _BLOCK), first, op))

        def moved(inner: Column) -> Column:
            before = F.concat(F.array(F.lit(first)), _fold(F.transform(inner, lambda x: F.element_at(x, -1)), first, op))
            return F.flatten(F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda x, lead: F.transform(x, lambda y: op(lead, y))))

        return _once(blocks, moved)

    return _once(values, whole)


def _spans(text: Column, pattern: str, kind: int, group: int) -> Column:
    """(s, k, e, v) of all matches: a match ends where the pieces between matches and the matches so far end."""

    def placed(found: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
        return F.zip_with(found, running(lengths, 0, lambda x, y: x + y), lambda m, end: F.struct((end - F.length(m)).alias("s"), F.lit(kind).alias("k"), end.alias("e"), value(m).alias("v")))

    return F.when(F.rlike(text, F.lit(pattern)), _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(F.expr(_NONE))


def _free(extra: Column, base: Column) -> Column:
    """The spans of ``extra`` that overlap none of ``base``, by one sweep over both in order.

    A span overlaps one that begins no later if that ends after its start, and one that begins later if that begins
    before its end; the latest end so far and the next start decide both.
    """
    owned = len(KINDS) - 1

    def sweep(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda x: F.when(x["k"] == owned, F.lit(-1)).otherwise(x["e"])), -1, lambda x, y: F.greatest(x, y))
        last = (1 << 31) - 1
        starts = F.reverse(running(F.reverse(F.transform(spans, lambda x: F.when(x["k"] == owned, F.lit(last)).otherwise(x["s"]))), last, lambda x, y: F.least(x, y)))
        rows = F.zip_with(F.zip_with(spans, ends, lambda x, end: F.struct(x.alias("x"), end.alias("end"))), starts, lambda r, start: F.struct(r["x"].alias("x"), r["end"].alias("end"), start.alias("start")))
        return F.transform(F.filter(rows, lambda r: (r["x"]["k"] == owned) & (r["end"] <= r["x"]["s"]) & (r["start"] >= r["x"]["e"])), lambda r: r["x"])

    return F.when((F.size(extra) > 0) & (F.size(base) > 0), _once(F.array_sort(F.concat(base, extra)), sweep)).otherwise(extra)


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def found_in(docs: DataFrame, repository: str = "source", owner: str = "source") -> DataFrame:
    """doc_id, repository, owner, and the arrays base and extra of (s, k, e, h): spans with their values' hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, "doc_id", "text", *dict.fromkeys((repository, owner)))
    rows = rows.select("doc_id", F.col(repository).alias("repository"), F.col(owner).alias("owner"), text.alias("text"))
    found = rows.select("doc_id", "repository", "owner", *[_spans(F.col("text"), p, k, g).alias(f"f{k}") for k, (p, g) in enumerate(((ASSIGN, 1), (ACCESS, 0), (HEX, 0), (CANDIDATE, 0)))])
    # Spans are structs that begin with s and k, so that their own order is the order asked for.
    base = F.array_sort(F.concat(F.filter("f0", lambda x: F.length(x["v"]) >= 8), F.col("f1"), F.col("f2")))
    live = lambda x: F.rlike(x["v"], F.lit("[0-9]")) & F.rlike(x["v"], F.lit("[a-z]")) & F.rlike(x["v"], F.lit("[A-Z]"))
    rows = found.select("doc_id", "repository", "owner", base.alias("base"), F.filter("f3", live).alias("f3"))
    hashed = lambda spans: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.xxhash64(x["v"]).alias("h")))
    return rows.select("doc_id", "repository", "owner", hashed(F.col("base")).alias("base"), hashed(_free(F.col("f3"), F.col("base"))).alias("extra"))


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(h, copied): the hashes of the values that more repositories or owners than allowed share."""
    if max_owners < 1:
        raise ValueError("max_owners must be 1 or more")
    values = found.select("repository", "owner", F.explode(F.concat("base", "extra")).alias("x")).select(F.col("x.h").alias("h"), "repository", "owner").distinct()
    counts = values.groupBy("h").agg(F.count_distinct("repository").alias("r"), F.count_distinct("owner").alias("o"))
    return counts.filter((F.col("r") > max_owners) | (F.col("o") > max_owners)).select("h", F.lit(True).alias("copied"))


def secrets(docs: DataFrame, repository: str = "source", owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and how many base spans look live, are copied, and were added."""
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.table(found_in(docs, repository, owner), "found")
    some = found.filter((F.size("base") > 0) | (F.size("extra") > 0))
    copied = scratch.table(ownership(some, max_owners), "ownership")
    spans = some.select("doc_id", F.explode(F.concat("base", "extra")).alias("x")).select("doc_id", "x.s", "x.e", "x.k", "x.h").distinct()
    owned = len(KINDS) - 1
    told = spans.join(if_few(copied), "h", "left").withColumn("copied", F.coalesce("copied", F.lit(False))).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when((F.col("k") == owned) & ~F.col("copied"), F.struct("s", "k", "e")))).alias("added"),
        F.count_if((F.col("k") != owned) & ~F.col("copied")).alias("n_live"),
        F.count_if((F.col("k") != owned) & F.col("copied")).alias("n_copied"),
    )
    told = scratch.table(told, "told")
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    every = F.array_sort(F.concat(base, F.coalesce("added", none)))
    number = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("bigint")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:-1])]
    out = found.select("doc_id", "base").join(told, "doc_id", "left")
    out = out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"), F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("bigint").alias("n_copied"), F.coalesce(F.size("added"), F.lit(0)).cast("bigint").alias("n_added"))
    return scratch.result(out)
