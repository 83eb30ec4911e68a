"""Near-duplicate documents by a MinHash LSH forest, confirmed on full shingle sets.

Documents with the same shingle set are one class, and only a class's first document goes on. A signature of ``HASHES``
minimum values is read in several orders. In each order, documents that share a prefix of ``LEAST_DEPTH`` values form
a region, and within the region's sorted order the neighbours with the longest common prefix are candidates. In regions
of up to ``CROWD`` documents all pairs are. Candidates are confirmed by the sizes of intersection and union of their full
sets, and links are joined into components.

Work goes in rounds so that crowds stay cheap. The first round links each document to its nearest neighbour in a few
orders; that joins most copies. Later rounds look only at regions that still hold several components, so a group of any
size costs a multiple of its size and never its square. A region's documents of one component count once.

Coverage: a pair at the threshold of 0.75 shares ``LEAST_DEPTH`` values of one order with probability 0.316 and of none
of the 32 disjoint ones with 5e-6. In a crowd two further ways hold that up. Documents beside a large component are
asked against all its documents, block by block and exactly (``crowd_links``). The documents of other crowds, such as
forms filled in differently, are joined exactly by the rarest shingles of their full sets (``rare_links``).

Cases: documents without words or text have an empty set and are linked with nothing; repeated rows of one doc_id are
copies of each other and keep that id, whatever their texts; a null doc_id is never the smallest of a component with
other ids, and rows without an id are linked only to texts that some id has; an empty table gives an empty result; of
extra columns none is read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findlode.llm import textscan as ts
from findlode.llm.shared import Scratch, if_few, only, unnamed

HASHES = 128
LEAST_DEPTH = 4
CROWD = 24
#: A region of more documents than this is cut into parts of about this many, and neighbours are sought within each part.
CHAIN = 1024
#: Documents, and shingles, of a block, where a crowd is asked block against block.
BLOCK = 2048
BLOCK_SHINGLES = 1 << 21
#: Shingles are counted in so many buckets where the rare ones of a crowd are told from the common ones.
BUCKETS = 1 << 18
#: Signatures that agree on fewer values than this (of 128) are more than six standard deviations below the threshold.
LEAST_AGREEING = 66
PERCENT = 75
#: Components take about log(n) rounds; not to end after so many is an error.
MOST_ROUNDS = 60

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_RUN = 2048


def signature(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), _RUN):
        np.minimum(out, (((low[None, k : k + _RUN] ^ _XOR) * _TIMES)).min(axis=1), out=out)
    return out


SIGNED = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sig array<int>"


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the shingle set, and the signature (zeros for an empty set). One pass."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ts.shingle_sets(batch.column(1))
            n, a, b = (np.zeros(len(batch), np.int64) for _ in range(3))
            sigs = np.zeros((len(batch), HASHES), np.uint32)
            for i, own in enumerate(sets):
                if len(own):
                    n[i] = len(own)
                    a[i] = ts.mix(own).sum(dtype=np.uint64).astype(np.int64)
                    b[i] = ts.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)
                    sigs[i] = signature(own)
            starts = pa.array(np.arange(0, HASHES * (len(batch) + 1), HASHES, dtype=np.int32))
            listed = pa.ListArray.from_arrays(starts, pa.array(sigs.reshape(-1).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), pa.array(a), pa.array(b), listed], names=["doc_id", "n_shingles", "set_a", "set_b", "sig"])

    return only(docs, "doc_id", "text").mapInArrow(sign, SIGNED)


def shingle_table(docs: DataFrame) -> DataFrame:
    """doc_id and the full shingle set as an array of 64-bit hashes."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ts.pieces(batch.column(1), 4 * ts.PIECE):
                part = batch.slice(a, b - a)
                sets = list(ts.shingle_sets(part.column(1)))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate([*sets, np.empty(0, np.uint64)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["doc_id", "shingles"])

    return only(docs, "doc_id", "text").mapInArrow(spell, "doc_id bigint, shingles array<bigint>")


def _orders(chosen: list[list[int]]) -> Column:
    """The orders as one literal, so that expressions over it stay short."""
    return F.array(*[F.array(*[F.lit(i) for i in o]) for o in chosen])


def _values(order: Column, first: int, count: int) -> Column:
    """``count`` values of the signature from place ``first`` of an order."""
    return F.transform(F.slice(order, first + 1, count), lambda i: F.get("sig", i))


def _deep(order: Column, at: int) -> Column:
    """Two values of the signature in one number that sorts as they do."""
    high, low = (F.get("sig", F.get(order, F.lit(at + k))).cast("bigint") for k in (0, 1))
    return F.shiftleft(high, 32) + low + F.lit(1 << 31)


def orders() -> list[list[int]]:
    """The orders of the signature, which start at disjoint fours."""
    return [[(LEAST_DEPTH * t + i) % HASHES for i in range(LEAST_DEPTH + 2)] for t in range(HASHES // LEAST_DEPTH)]


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of regions that hold two components or more, with the region's size.

    Sizes are counted first, with partial sums in each task, so that a region of any size is dealt out by the join.
    """
    size = rows.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("region", "size")
    return rows.join(size, "region")


def regions(sigs: DataFrame) -> DataFrame:
    """(region, t, deep, comp, doc_id, size): documents under each order's prefix of ``LEAST_DEPTH`` values."""
    keys = F.transform(_orders(orders()), lambda o, t: F.struct(F.xxhash64(t, _values(o, 0, LEAST_DEPTH)).alias("region"), _deep(o, LEAST_DEPTH).alias("deep")))
    return _shared(sigs.select("comp", "doc_id", F.posexplode(keys).alias("t", "key")).select("key.region", "t", "key.deep", "comp", "doc_id"))


def chains(members: DataFrame) -> DataFrame:
    """Each document with the one before it in its region's order, its neighbour of longest common prefix.

    Pairs of one component are left out. A region beyond ``CHAIN`` is cut by a hash of the document that differs from order
    to order, so that no task sorts a region of any size; what one order keeps apart another brings together, and what
    still is in several components then is asked as a crowd, exactly.
    """
    part = F.pmod(F.xxhash64("t", "doc_id"), F.ceil(F.col("size") / CHAIN))
    w = Window.partitionBy("region", part).orderBy("deep", "comp", "doc_id")
    return members.select("doc_id", "comp", F.lag("doc_id").over(w).alias("b"), F.lag("comp").over(w).alias("comp_b")).filter("b is not null and comp != comp_b").select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b"))


def neighbours(members: DataFrame) -> DataFrame:
    """Each document with those up to ``CROWD`` places before it in a small region, where their components differ."""
    w = Window.partitionBy("region").orderBy("comp", "doc_id").rowsBetween(-CROWD, -1)
    pairs = members.select("doc_id", "comp", F.collect_list(F.struct("doc_id", "comp")).over(w).alias("before")).select("doc_id", "comp", F.explode("before").alias("x"))
    return pairs.filter("comp != x.comp").select(F.least("doc_id", "x.doc_id").alias("a"), F.greatest("doc_id", "x.doc_id").alias("b"))


def _agreeing(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pairs:
        a, b = (batch.column(i).flatten().to_numpy().reshape(-1, HASHES) for i in (2, 3))
        yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= LEAST_AGREEING))


def alike(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs whose signatures agree on at least ``LEAST_AGREEING`` values."""
    with_a = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a")
    both = with_a.join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(_agreeing, "a bigint, b bigint")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    n = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * n >= percent * (F.size("x") + F.size("y") - n)).select("a", "b")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, comp): the smallest id reachable over ``links``, for the documents that have a link.

    Alternates two shuffles: each node hands its smallest neighbour to its larger ones, then to its smaller ones
    ("large star, small star"), which ends in stars after about log(n) rounds, whatever the shape of the links.
    """
    edges = scratch.table(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-e")
    for i in range(MOST_ROUNDS):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: u's larger neighbours are tied to the smallest of u and its neighbours.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, f"{name}-l{i}")
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), "m").filter("u != m").unionByName(low).select("u", F.col("m").alias("v")).distinct()
        small = scratch.table(small, f"{name}-s{i}")
        heads = small.select(F.col("v").alias("u")).distinct()
        many = small.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        ended = small.join(heads, "u", "left_semi").select("u").unionByName(many).isEmpty()
        scratch.drop(f"{name}-l{i}")
        edges = small
        if ended:
            break
    else:
        raise RuntimeError(f"components are not found after {MOST_ROUNDS} rounds")
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("comp")).distinct())


def _linked(sets: list[np.ndarray], percent: int):
    """A function that finds the places of the sets that a set is linked with, through an inverted index."""
    sizes = np.array([len(x) for x in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    turn = np.argsort(every, kind="stable")
    every, owner = every[turn], owner[turn]

    def find(own: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(every, own), np.searchsorted(every, own, "right")
        hits = np.concatenate([owner[x:y] for x, y in zip(lo, hi, strict=True)]) if len(own) else owner[:0]
        n = np.bincount(hits, minlength=len(sets))
        return np.flatnonzero(100 * n >= percent * (sizes + len(own) - n))

    return find


def _first_links(percent: int):
    def match(body: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        """For each asking document one document of the block that it is linked with, if there is any."""
        if not len(body) or not len(asks):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        find = _linked([np.asarray(x) for x in body["body_set"]], percent)
        out = []
        for doc, own in zip(asks["doc_id"], asks["asks_set"], strict=True):
            linked = find(np.asarray(own))
            if len(linked):
                out.append((doc, body["doc_id"].iloc[int(linked[0])]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return match


def crowd_links(crowded: DataFrame, now: DataFrame, sizes: DataFrame, sets: DataFrame, scratch: Scratch, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Links between a crowd's large components and the documents beside them, exactly; and the rows still to be asked.

    Where more than ``CROWD`` documents of a component share a region, the region's documents of other components are
    asked against the full sets of all documents of that component. Only there do its documents leave the region: where
    fewer of them are, nothing has been asked against it. Both go in blocks, a block against a block in a
    task, through an inverted index of the block's shingles; only links come out, one per document and block.
    """
    large = scratch.table(crowded.groupBy("region", "comp").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("region", F.col("comp").alias("main")), "large")
    mains = scratch.table(large.select("main").distinct(), "mains")
    own = large.select("region", F.col("main").alias("comp"), F.lit(True).alias("both"))
    asks = crowded.join(large, "region").filter("comp != main").join(own, ["region", "comp"], "left")
    # Of two components that are large in one region, the one of the larger id asks.
    # sizes: (doc_id, n_shingles); blocks are cut by documents and by shingles, which bounds a task's memory.
    asks = scratch.table(asks.filter("both is null or comp > main").select("doc_id", "main").distinct(), "asks")
    body = scratch.table(now.join(mains, now["comp"] == mains["main"]).select("doc_id", "main"), "body")
    cut = lambda rows, name: rows.join(sizes, "doc_id").groupBy("main").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias(name))
    blocks = cut(body, "nb").join(cut(asks, "nq"), "main")
    blocks = scratch.table(blocks, "blocks")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    named = lambda side: sets.select("doc_id", F.col("shingles").alias(f"{side}_set"))
    left = body.join(blocks, "main").select("main", "doc_id", F.pmod(F.xxhash64("doc_id"), "nb").cast("int").alias("b"), upto("nq").alias("q")).join(named("body"), "doc_id")
    right = asks.join(blocks, "main").select("main", "doc_id", upto("nb").alias("b"), F.pmod(F.xxhash64("doc_id"), "nq").cast("int").alias("q")).join(named("asks"), "doc_id")
    found = left.groupBy("main", "b", "q").cogroup(right.groupBy("main", "b", "q")).applyInPandas(_first_links(percent), "a bigint, b bigint")
    return scratch.table(found, "crowd-links"), crowded.join(own, ["region", "comp"], "left_anti")


def _joining_links(percent: int):
    def match(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links between two blocks, or within one, as many as join all components that any of its links joins."""
        _, lo, hi = key
        body, asks = rows[rows["k"] == lo], rows[rows["k"] == hi]
        out = []
        if len(body) and len(asks):
            find = _linked([np.asarray(x) for x in body["shingles"]], percent)
            names, part = np.unique(np.concatenate([body["comp"], asks["comp"]]), return_inverse=True)
            parts, ids = part[: len(body)], body["doc_id"].to_numpy()
            now = np.arange(len(names))
            for doc, comp, own in zip(asks["doc_id"], part[len(body) :].tolist(), asks["shingles"], strict=True):
                linked = find(np.asarray(own))
                others, first = np.unique(now[parts[linked]], return_index=True)
                for other, at in zip(others.tolist(), linked[first].tolist(), strict=True):
                    if other != now[comp]:
                        out.append((doc, ids[at]))
                        now[now == other] = now[comp]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return match


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (ts.mix(shingles.view(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _listed(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each list begins and the last ends."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def rare_shingles(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(region, comp, doc_id): the rarest shingles of each set, so many that two linked sets have one of them in common.

    Linked sets share at least ``percent`` of each, so in any one order of all shingles they meet within the first
    n - ceil(n * percent / 100) + 1 of both. The order is by the counts of buckets, which have a fixed size; how well they
    tell common shingles decides the work and never the result. sets: (doc_id, comp, shingles).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n += np.bincount(_bucket(_listed(batch, "shingles")[0]), minlength=BUCKETS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    found = sets.select("shingles").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > CROWD).toArrow()
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = _listed(batch, "shingles")
            chosen = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = values[a:b]
                turn = np.lexsort((own, shared.value[_bucket(own)]))
                chosen.append(own[turn[: len(own) - (percent * len(own) + 99) // 100 + 1]] if len(own) else own)
            rows = np.repeat(np.arange(len(chosen)), [len(x) for x in chosen])
            ids = batch.select(["comp", "doc_id"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*chosen, values[:0]])), ids.column(0), ids.column(1)], names=["region", "comp", "doc_id"])

    return sets.select("comp", "doc_id", "shingles").mapInArrow(rarest, "region bigint, comp bigint, doc_id bigint")


def rare_links(rows: DataFrame, sets: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """Links, exactly, among the documents of a shingle that is among the rarest of more than ``CROWD``.

    They go block against block, on full sets, and as many links come out as join what is joined. Shingles that the same
    documents share are asked once. rows: crowded ones of ``rare_shingles`` with their size; sets: (doc_id, comp, shingles).
    """
    groups = rows.join(sets.select("doc_id", F.size("shingles").alias("n")), "doc_id").groupBy("region").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who"))
    groups = groups.groupBy("docs", "n", "who").agg(F.min("region").alias("region"))
    groups = scratch.table(groups.select("region", F.ceil(F.greatest(F.col("docs") / BLOCK, F.col("n") / BLOCK_SHINGLES)).cast("int").alias("nb")), "rare-groups")
    dealt = rows.select("region", "doc_id").join(groups, "region").withColumn("k", F.pmod(F.xxhash64("doc_id"), "nb").cast("int")).select("region", "doc_id", "k", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    dealt = dealt.select("region", "doc_id", "k", F.least("k", "o").alias("lo"), F.greatest("k", "o").alias("hi")).join(sets, "doc_id")
    return scratch.table(dealt.groupBy("region", "lo", "hi").applyInPandas(_joining_links(percent), "a bigint, b bigint"), "rare-links")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable, itself included) and kept (doc_id = component_id)."""
    scratch = Scratch(docs.sparkSession, "neardup")
    every = scratch.table(signed(docs), "signed")
    classes = scratch.table(every.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")).filter("rep is not null"), "classes")
    sigs = classes.select(F.col("rep").alias("doc_id"), F.col("rep").alias("comp"), "sig")
    # A first look at all orders says which documents share any region; only these need their signatures and full sets.
    members = scratch.table(regions(sigs), "members")
    shared = scratch.table(members.select("doc_id").distinct(), "shared")
    wanted = if_few(shared)
    sigs = scratch.table(sigs.join(wanted, "doc_id", "left_semi").select("doc_id", "sig"), "sigs")
    sets = scratch.table(shingle_table(only(docs, "doc_id", "text").join(wanted, "doc_id", "left_semi")), "sets")
    now = sigs.select("doc_id", F.col("doc_id").alias("comp")).distinct()
    links: list[DataFrame] = []
    asked: list[DataFrame] = []

    def ask(pairs: DataFrame, name: str) -> None:
        """Confirms the pairs not asked before."""
        pairs = pairs.distinct()
        for before in asked:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = scratch.table(alike(pairs, sigs), f"{name}-pairs")
        if not pairs.isEmpty():
            asked.append(pairs)
            links.append(scratch.table(confirmed(pairs, sets, percent), f"{name}-links"))

    def joined(name: str) -> DataFrame:
        """Each document's component over the links so far."""
        if not links:
            return now
        reached = components(functools.reduce(DataFrame.unionByName, links), scratch, name)
        return scratch.table(sigs.select("doc_id").distinct().join(reached, "doc_id", "left").select("doc_id", F.coalesce("comp", "doc_id").alias("comp")), f"{name}-now")

    def again(members: DataFrame, name: str) -> DataFrame:
        """The regions with today's components, without those that have become one."""
        return scratch.table(_shared(members.drop("comp", "size").join(now, "doc_id")), name)

    ask(chains(members.filter("t < 4")), "near")
    now = joined("near")
    members = again(members, "members1")
    ask(chains(members), "chain")
    now = joined("chain")
    members = again(members, "members2")
    crowded = members.filter(F.col("size") > CROWD)
    if not crowded.isEmpty():
        found, rest = crowd_links(crowded, now, classes.select(F.col("rep").alias("doc_id"), "n_shingles"), sets, scratch, percent)
        links.append(found)
        # What meets a component where it is large has now been asked; other regions keep their pairs with it.
        members = scratch.table(members.filter(F.col("size") <= CROWD).unionByName(_shared(rest.drop("size")).select(members.columns)), "members3")
    ask(neighbours(members.filter(F.col("size") <= CROWD)), "leaf")
    now = joined("leaf")
    crowd = scratch.table(_shared(members.filter(F.col("size") > CROWD).drop("comp", "size").join(now, "doc_id")).select("doc_id").distinct(), "crowd")
    if not crowd.isEmpty():
        dense = scratch.table(sets.join(crowd, "doc_id", "left_semi").join(now, "doc_id").select("doc_id", "comp", "shingles"), "dense")
        rare = scratch.table(_shared(rare_shingles(dense, percent)), "rare")
        ask(neighbours(rare.filter(F.col("size") <= CROWD)), "rare-leaf")
        links.append(rare_links(rare.filter(F.col("size") > CROWD), dense, scratch, percent))
        now = joined("rare")
    tied = classes.select("set_a", "set_b", F.col("rep").alias("doc_id")).join(now, "doc_id", "left").select("set_a", "set_b", F.coalesce("comp", "doc_id").alias("comp"))
    out = every.select("doc_id", "n_shingles", "set_a", "set_b").join(tied, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
    return scratch.result(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that are the first of their component, with all their columns; rows without an id all stay."""
    gone = near_duplicates(docs, percent).filter("not kept").select("doc_id")
    own = unnamed(docs)
    return own.join(if_few(gone), F.col(f"_{docs.columns.index('doc_id')}") == F.col("doc_id"), "left_anti").toDF(*docs.columns)
