import random

import pytest

from findlode.operators import graph


def reach(edges, nodes):
    out = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = out[b] - out[a]
            if new:
                out[a] |= new
                changed = True
    return out


@pytest.mark.parametrize("seed", range(3))
def test_components_and_strong_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(26)] + [(30, 30), (40, 41), (41, 42), (42, 40)]
    nodes = {x for e in edges for x in e}
    both = reach(edges + [(b, a) for a, b in edges], nodes)
    table = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src bigint, dst bigint, score double")
    assert {r["node"]: r["comp"] for r in graph.components(table).collect()} == {n: min(v) for n, v in both.items()}
    along = reach(edges, nodes)
    want = {n: min(m for m in nodes if m in along[n] and n in along[m]) for n in nodes}
    assert {r["node"]: r["comp"] for r in graph.strong_components(table, 0.5).collect()} == want


def test_strong_components_end_when_no_node_is_left(spark):
    import inspect

    assert "rounds" not in inspect.signature(graph.strong_components).parameters
    assert graph.strong_components(spark.createDataFrame([], "src bigint, dst bigint")).collect() == []


def test_image_graph_drops_itself_and_low_scores(spark):
    rows = spark.createDataFrame([(1, 1, 9.0), (1, 2, 5.0), (1, 3, 5.0), (1, 4, 0.1), (2, 1, 0.2)], "src bigint, dst bigint, score double")
    assert sorted(tuple(r) for r in graph.image_graph(rows, 1, 0.3).collect()) == [(1, 2, 5.0)]


def test_sets(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (7, 6), (6, 6), (8, 6)], "node bigint, comp bigint")
    table = graph.sets(nodes)
    assert [tuple(r) for r in table.orderBy("set_id").collect()] == [(0, 2, [1, 2]), (1, 3, [6, 7, 8])]
    assert {r["bucket"]: r["n"] for r in graph.size_buckets(table).collect()} == {2: 1, 3: 1}
    one = spark.createDataFrame([(7,)], "member_id bigint")
    assert [r["set_id"] for r in graph.sets_with(table, one).collect()] == [1]


def test_non_matches(spark):
    ranked = spark.createDataFrame([(1, 1, 9.0, 1), (1, 2, 3.0, 2), (2, 2, 9.0, 1), (2, 3, 8.0, 2)], "query_id bigint, doc_id bigint, score double, rank int")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id bigint")
    assert sorted(tuple(r) for r in graph.non_matches(ranked, queries, 5.0).collect()) == [(1, 1, 3.0), (3, 0, 0.0)]
