"""File and region metadata: the query string, full text, group statistics, paging."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlode.functions.prefix import running_total
from findlode.functions.text import numbers, tokens

PAGE = 20
SET_PAGE = 10
GROUPS = 512


class Rejected(ValueError):
    """A query string that says nothing that can be answered."""


@dataclass(frozen=True)
class Equals:
    column: str
    value: str


@dataclass(frozen=True)
class Between:
    column: str
    low: str
    high: str


@dataclass(frozen=True)
class FullText:
    words: str


def parsed(query: str, columns: list[str]) -> Equals | Between | FullText:
    """``name=value``, ``name=(low,high)``, or, without an equals sign, words for the full text."""
    if "=" not in query:
        return FullText(query)
    name, value = query.split("=", 1)
    if name not in columns:
        raise Rejected(f"there is no column {name!r}")
    if not value:
        raise Rejected("a value is missing")
    if "(" not in value and ")" not in value:
        return Equals(name, value)
    m = re.fullmatch(r"\(([^(),]+),([^(),]+)\)", value)
    if not m:
        raise Rejected(f"{value!r} is no range")
    return Between(name, m[1], m[2])


def condition(query: Equals | Between, table: DataFrame) -> Column:
    """The query as a condition; literals take the column's type, so that numbers compare as numbers."""
    kind = table.schema[query.column].dataType
    if isinstance(query, Equals):
        return F.col(query.column) == F.lit(query.value).cast(kind)
    return F.col(query.column).between(F.lit(query.low).cast(kind), F.lit(query.high).cast(kind))


def ids_where(table: DataFrame, query: Equals | Between) -> DataFrame:
    return table.filter(condition(query, table)).select("file_id").distinct()


def joined_text(files: DataFrame, regions: DataFrame | None, columns: list[str]) -> DataFrame:
    """(file_id, text): all attributes as one text, a row for each of a file's regions and one for a file without any."""
    rows = files if regions is None else files.join(regions, "file_id", "left")
    return rows.select("file_id", F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("text"))


def token_table(texts: DataFrame) -> DataFrame:
    """(file_id, pos, token) of a text table."""
    return texts.select("file_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token")).filter("token != ''")


def _term(term: str) -> Column:
    return F.col("token").startswith(term[:-1].lower()) if term.endswith("*") else F.col("token") == term.lower()


def matching(table: DataFrame, words: str) -> DataFrame:
    """file_ids whose tokens match: words (AND between them is implied), prefix*, OR, NOT, and "phrases".

    ``table`` is a token table. Each alternative is one pass with a flag per term, not one join per term.
    """
    alternatives = [a for a in re.split(r"\s+OR\s+", words.strip()) if a.strip()]
    if not alternatives:
        raise Rejected("there are no words")
    found = None
    for text in alternatives:
        wanted, refused, phrases = [], [], [p.split() for p in re.findall(r'"([^"]+)"', text)]
        negate = False
        for term in re.sub(r'"[^"]*"', " ", text).split():
            if term == "AND":
                continue
            if term == "NOT":
                negate = True
                continue
            (refused if negate else wanted).append(term)
            negate = False
        wanted += [t for p in phrases for t in p]
        if not wanted:
            raise Rejected("there is nothing to look for")
        any_of = None
        for t in [*wanted, *refused]:
            any_of = _term(t) if any_of is None else any_of | _term(t)
        flags = [F.max(_term(t).cast("int")).alias(f"w{i}") for i, t in enumerate(wanted)] + [F.max(_term(t).cast("int")).alias(f"r{i}") for i, t in enumerate(refused)]
        rows = table.filter(any_of).groupBy("file_id").agg(*flags)
        for i in range(len(wanted)):
            rows = rows.filter(F.col(f"w{i}") == 1)
        for i in range(len(refused)):
            rows = rows.filter(F.col(f"r{i}") == 0)
        rows = rows.select("file_id")
        for phrase in phrases:
            starts = None
            for i, t in enumerate(phrase):
                at = table.filter(_term(t)).select("file_id", (F.col("pos") - i).alias("at")).distinct()
                starts = at if starts is None else starts.join(at, ["file_id", "at"])
            rows = rows.join(starts.select("file_id").distinct(), "file_id", "left_semi")
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def search(query: str, files: DataFrame, table: DataFrame) -> DataFrame:
    """file_ids that a query string asks for. files: the metadata; table: its token table."""
    what = parsed(query, files.columns)
    return matching(table, what.words) if isinstance(what, FullText) else ids_where(files, what)


def names_like(files: DataFrame, pattern: str) -> DataFrame:
    """file_ids by LIKE, which doesn't mind case."""
    return files.filter(F.col("filename").ilike(pattern)).select("file_id")


def group_counts(files: DataFrame, by: str, limit: int | None = GROUPS, within: DataFrame | None = None) -> DataFrame:
    """(value, n) of a column's values that aren't null; the first ``limit`` in order. within: only these file_ids."""
    rows = files if within is None else files.join(within, "file_id", "left_semi")
    counts = rows.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("value")).agg(F.count("file_id").alias("n"))
    return counts if limit is None else counts.orderBy("value").limit(limit)


def group_members(files: DataFrame, by: str, value: str, within: DataFrame | None = None) -> DataFrame:
    """file_ids of a group. The reference behaviour is without ``within``: a group's list doesn't mind the text query."""
    rows = files.filter(F.col(by) == F.lit(value).cast(files.schema[by].dataType))
    return (rows if within is None else rows.join(within, "file_id", "left_semi")).select("file_id")


def page_bounds(size: int, start: int, end: int, page: int = PAGE) -> tuple[int, int]:
    """A page that doesn't fit begins at 0, and one that ends nowhere ends after ``page`` rows or with the list."""
    if start >= size or start < 0:
        start = 0
    if end <= start or end > size:
        end = min(start + page, size) if start else min(page, size)
    return start, end


def paged(rows: DataFrame, order: list[str], start: int, end: int, page: int = PAGE) -> DataFrame:
    """The rows from ``start`` up to ``end`` in order, by the rules above."""
    start, end = page_bounds(rows.count(), start, end, page)
    return rows.orderBy(*order).offset(start).limit(end - start)


def sampled(rows: DataFrame, key: str, n: int = 100, seed: int = 0) -> DataFrame:
    """``n`` rows at random, the same ones every time for a seed."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def shuffled_until(rows: DataFrame, key: str, size: str, total: int, seed: int = 42) -> DataFrame:
    """Rows in a shuffled order, as long as the sizes before a row don't reach the total."""
    turn = F.xxhash64(F.col(key), F.lit(seed))
    summed = running_total(rows.withColumn("turn", turn), ["turn", key], F.col(size), "upto")
    return summed.filter(F.col("upto") - F.col(size) < total).drop("upto", "turn")


def region_box(points: Column) -> Column:
    """The rectangle x, y, w, h of a region's points."""
    n = numbers(points)
    return F.struct(*[F.get(n, F.lit(i)).alias(c) for i, c in enumerate("xywh")])


def regions_of(regions: DataFrame, ids: DataFrame) -> DataFrame:
    """The regions of the given files."""
    return regions.join(ids.select("file_id").distinct(), "file_id", "left_semi")
