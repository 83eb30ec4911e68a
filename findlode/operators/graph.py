"""Match graphs: top neighbours of every document, components, and the sets they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findlode.functions.prefix import numbered
from findlode.functions.session import checkpointed


#: Components take about log(n) rounds; not to end after so many is an error.
MOST_ROUNDS = 60
#: Where the ranges of set sizes begin.
SIZE_EDGES = (2, 3, 4, 5, 10, 20, 50, 100, 5000)


def image_graph(scores: DataFrame, most: int, threshold: float) -> DataFrame:
    """(src, dst, score): of each document's best ``most``, itself left out, those that reach the threshold."""
    ranked = scores.filter("src != dst").withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.col("score").desc(), "dst")))
    return ranked.filter((F.col("rank") <= most) & (F.col("score") >= threshold)).drop("rank")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of an edge reaches, edges taken both ways.

    Nodes hand the smallest neighbour on to their larger ones, then to their smaller ones, until only stars are left.
    """
    now = checkpointed(edges.filter("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    alone = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = checkpointed(large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        done = small.join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and small.groupBy("u").count().filter("count > 1").isEmpty()
        now = small
        if done:
            break
    else:
        raise RuntimeError(f"components are not found after {MOST_ROUNDS} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
    return found.unionByName(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("comp")))


def _reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, colour): the smallest colour that reaches each node along the edges. starts: (node, colour)."""
    now = checkpointed(starts)
    while True:
        handed = edges.join(now, edges["src"] == now["node"]).select(F.col("dst").alias("node"), "colour")
        best = checkpointed(now.unionByName(handed).groupBy("node").agg(F.min("colour").alias("colour")))
        settled = best.count() == now.count() and best.join(now.withColumnRenamed("colour", "old"), "node").filter("colour != old").isEmpty()
        now = best
        if settled:
            return now


def strong_components(edges: DataFrame, threshold: float | None = None) -> DataFrame:
    """(node, comp): nodes that reach each other along directed edges, named by their smallest node.

    Each round every node takes the smallest node that reaches it as its colour; the nodes of a colour that reach its
    root back are a component, and leave the graph. Each round takes a node at least, so it ends when none is left.
    """
    links = edges if threshold is None else edges.filter(F.col("score") >= threshold)
    links = checkpointed(links.select("src", "dst").distinct())
    left = checkpointed(links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).filter("node is not null").distinct())
    out = left.filter("false").select("node", F.col("node").alias("comp"))
    while not left.isEmpty():
        colours = _reached(links, left.select("node", F.col("node").alias("colour")))
        same = links.join(colours.withColumnRenamed("node", "src").withColumnRenamed("colour", "c1"), "src").join(colours.withColumnRenamed("node", "dst").withColumnRenamed("colour", "c2"), "dst").filter("c1 = c2")
        backward = checkpointed(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = colours.filter("node = colour")
        home = _reached(backward, roots)
        found = checkpointed(home.join(colours.withColumnRenamed("colour", "c"), "node").filter("colour = c").select("node", F.col("c").alias("comp")))
        out = out.unionByName(found)
        left = checkpointed(left.join(found, "node", "left_anti"))
        links = checkpointed(links.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return out


def sets(nodes: DataFrame, least: int = 2) -> DataFrame:
    """(set_id, set_size, members): components of ``least`` nodes or more, numbered by their smallest node."""
    own = nodes.groupBy("comp").agg(F.count("*").alias("set_size"), F.sort_array(F.collect_list("node")).alias("members")).filter(F.col("set_size") >= least)
    return numbered(own, ["comp"], "set_id").select("set_id", "set_size", "members")


def inverse_sets(table: DataFrame) -> DataFrame:
    """(member_id, set_id)."""
    return table.select(F.explode("members").alias("member_id"), "set_id")


def sizes(table: DataFrame) -> DataFrame:
    return table.groupBy("set_size").agg(F.count("*").alias("n"))


def size_buckets(table: DataFrame, edges: tuple[int, ...] = SIZE_EDGES) -> DataFrame:
    """(bucket, n): sets by half-open ranges of their size."""
    low = None
    for lo, hi in zip(edges, edges[1:], strict=False):
        inside = (F.col("set_size") >= lo) & (F.col("set_size") < hi)
        low = F.when(inside, F.lit(lo)) if low is None else low.when(inside, F.lit(lo))
    return table.select(low.alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def sets_with(table: DataFrame, members: DataFrame) -> DataFrame:
    """The sets that hold one of the given members."""
    return table.join(inverse_sets(table).join(members, "member_id", "left_semi").select("set_id").distinct(), "set_id", "left_semi")


def non_matches(scores: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """(query_id, result_count, max_score) of queries no result of which reaches the threshold.

    scores: (query_id, doc_id, score), the query itself among them; the count is without it, the score the second of all.
    """
    first = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2)
    two = scores.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))).filter("place <= 2").groupBy("query_id").agg(first.alias("first"))
    own = scores.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("doc_id") != F.col("query_id"), F.col("score"))).alias("best")).join(two, "query_id")
    rows = queries.join(own, "query_id", "left")
    return rows.filter(F.col("best").isNull() | (F.col("best") < threshold)).select("query_id", F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0)).cast("bigint").alias("result_count"), F.coalesce(F.get("first", F.lit(1)), F.lit(0.0)).alias("max_score"))


def non_matching(first: DataFrame, threshold: float) -> DataFrame:
    """As ``non_matches`` from each query's first two results and the number of all: (query_id, doc_id, score, rank, n)."""
    other = F.max(F.when(F.col("doc_id") != F.col("query_id"), F.col("score")))
    rows = first.filter("rank <= 2").groupBy("query_id").agg(F.first("n").alias("n"), other.alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    rows = rows.filter(F.col("best").isNull() | (F.col("best") < threshold))
    return rows.select("query_id", F.greatest(F.col("n") - 1, F.lit(0)).cast("bigint").alias("result_count"), F.coalesce("second", F.lit(0.0)).alias("max_score"))


def unfinished(queries: DataFrame, progress: DataFrame) -> DataFrame:
    """The queries that an earlier run hasn't finished."""
    return queries.join(progress, "query_id", "left_anti")


def exported(table: DataFrame, names: DataFrame) -> DataFrame:
    """(set_id, set_size, set_files): the sets with their members' file names, in the members' order."""
    rows = table.select("set_id", "set_size", F.posexplode("members").alias("place", "member_id")).join(names.select(F.col("file_id").alias("member_id"), "filename"), "member_id")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "filename"))), lambda x: x["filename"])
    return rows.groupBy("set_id", "set_size").agg(F.array_join(ordered, ",").alias("set_files"))
