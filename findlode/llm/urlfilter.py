"""URL filters as a temporal list join. DataFrame operations only.

A list is dated: an entry adds a key, or takes it off again. A key is a host, a domain with all that lies below it, or a
host with the beginning of a path, in whole segments. Entries of a key become validity intervals, from each addition to
the key's next entry. A capture has its host, the domains above it and its path's beginnings as keys; the join is on the
key, and of a key's intervals the one that holds the fetch time is taken: the list as of that time.

Cases: a null or unreadable URL has a null host and is never blocked, as is one with a null fetch time; entries without
key, date or action are left out; of entries of one key and date a removal counts last, and repeated ones count once;
repeated captures each get their row; empty tables give an empty, or an unblocked, result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findlode.llm.shared import if_few, only

#: The parts of an address.
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, key, category, since, until) of the entries (kind, key, category, action, entry_date); until is open where null.

    An addition holds until the key's next entry, whatever that is.
    """
    entries = only(entries, "kind", "key", "category", "action", "entry_date")
    known = entries.select("kind", F.lower("key").alias("key"), "category", "action", F.col("entry_date").cast("date").alias("entry_date")).filter("kind is not null and key is not null and action in ('add', 'remove') and entry_date is not null").distinct()
    daily = known.groupBy("kind", "key", "entry_date").agg(F.max(F.struct("action", "category")).alias("last"))
    nxt = F.lead("entry_date").over(Window.partitionBy("kind", "key").orderBy("entry_date"))
    return daily.select("kind", "key", "last.category", "last.action", F.col("entry_date").alias("since"), nxt.alias("until")).filter("action = 'add'").drop("action")


def keys(captures: DataFrame) -> DataFrame:
    """The captures (page_id, url, fetch_date) with a hash of the url, their host and an array of (kind, key, weight), the most specific the heaviest."""
    host = F.lower(F.regexp_extract("url", _HOST, 1))
    path = F.regexp_extract("url", _PATH, 1)
    rows = captures.select("page_id", F.xxhash64("url").alias("own"), F.col("fetch_date").cast("date").alias("fetch_date"), F.nullif(host, F.lit("")).alias("host"), path.alias("path"))
    labels, parts = F.split("host", r"\."), F.filter(F.split("path", "/"), lambda x: x != "")
    key = lambda kind, value, weight: F.struct(F.lit(kind).alias("kind"), value.alias("key"), weight.cast("int").alias("weight"))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: key("domain", F.array_join(F.slice(labels, i, F.size(labels)), "."), F.size(labels) - i))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: key("prefix", F.concat(F.col("host"), F.lit("/"), F.lower(F.array_join(F.slice(parts, 1, i), "/"))), i + 1000))
    own = F.array(key("host", F.col("host"), F.lit(500)))
    every = F.when(F.col("host").isNull(), None).when(F.size(parts) > 0, F.concat(domains, own, prefixes)).otherwise(F.concat(domains, own))
    return rows.select("page_id", "own", "fetch_date", "host", every.alias("keys"))


def filtered(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, n_active (keys listed as of the fetch date), blocked, and the most specific key, its category and date.

    A list that is counted as short is broadcast: then a capture's keys meet it where the capture is read, and what is
    shuffled are hits alone. Beyond that both are dealt out by the key, and Spark splits the keys that crowd.
    """
    asked = keys(only(captures, "page_id", "url", "fetch_date"))
    active = if_few(intervals(entries))
    rows = asked.select("page_id", "fetch_date", "own", F.explode("keys").alias("x")).select("page_id", "fetch_date", "own", "x.kind", "x.key", "x.weight")
    hits = rows.join(active, ["kind", "key"]).filter("fetch_date >= since and (until is null or fetch_date < until)")
    # A set of hits is no longer than its address has keys; repeated captures add nothing to it.
    best = hits.groupBy("page_id", "fetch_date", "own").agg(F.collect_set(F.struct("weight", "kind", "key", "category", "since")).alias("hits"))
    best = best.select(*[F.col(c).alias(f"{c}_") for c in ("page_id", "fetch_date", "own")], F.size("hits").alias("n_active"), F.array_max("hits").alias("best"))
    out = asked.join(best, F.col("page_id").eqNullSafe(F.col("page_id_")) & (F.col("fetch_date") == F.col("fetch_date_")) & (F.col("own") == F.col("own_")), "left")
    return out.select("page_id", "host", F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"), F.col("best").isNotNull().alias("blocked"), F.concat_ws(":", "best.kind", "best.key").alias("entry"), F.col("best.category").alias("category"), F.col("best.since").cast("string").alias("since"))
