"""Column expressions for text, URLs and small codes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of a to z, in order; empty strings at the ends or between stand for other characters."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+")


def numbers(csv: Column) -> Column:
    """The numbers of a comma-separated list."""
    return F.transform(F.split(csv, ","), lambda x: F.trim(x).cast("double"))


def transform_csv(h: Column) -> Column:
    """The first six coefficients of a row-major 3x3 transform, six decimals each."""
    return F.format_string("%.6f,%.6f,%.6f,%.6f,%.6f,%.6f", *[F.get(h, F.lit(i)) for i in range(6)])


def region_csv(*parts: Column) -> Column:
    """A region's numbers, four decimals each."""
    return F.format_string(",".join(["%.4f"] * len(parts)), *parts)


def short_count(n: Column) -> Column:
    """1000 as 1k, 1000000 as 1m; the unit is the largest that divides without a rest."""
    million, thousand = F.lit(1_000_000), F.lit(1000)
    return F.when((n >= million) & (n % million == 0), F.concat((n / million).cast("bigint").cast("string"), F.lit("m"))).when((n >= thousand) & (n % thousand == 0), F.concat((n / thousand).cast("bigint").cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def query_parameters(uri: Column) -> Column:
    """The decoded parameters of a URI as a map; + is a space."""
    query = F.regexp_extract(uri, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    entry = lambda x: F.struct(F.url_decode(F.regexp_extract(x, "^([^=]*)", 1)).alias("key"), F.url_decode(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("value"))
    return F.map_from_entries(F.transform(pairs, entry))


def path_parts(uri: Column) -> Column:
    """The path's components, without empty ones."""
    path = F.regexp_replace(F.regexp_replace(uri, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.filter(F.split(path, "/"), lambda x: x != "")


def whole_match(column: Column, pattern: str) -> Column:
    """Whether the pattern matches all of the string."""
    return column.rlike(f"^(?:{pattern})$")


_UNSAFE = re.compile(r"[\"';\\]")


def safe_query(text: str, longest: int = 128) -> str:
    """The query text, if it has none of the refused characters and isn't too long; otherwise ValueError."""
    if len(text) > longest:
        raise ValueError(f"a query has at most {longest} characters")
    if _UNSAFE.search(text):
        raise ValueError("a query has no quotes, semicolons or backslashes")
    return text
