import numpy as np
from pyspark.sql import functions as F

from findlode.operators import evaluate, training
from findlode.operators import vectors as vx


def table(spark, x, name="feat_id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} bigint, vec array<double>")


def test_nearest_words_are_exact_also_in_blocks(spark):
    rng = np.random.default_rng(1)
    x, c = rng.standard_normal((300, 6)), rng.standard_normal((40, 6))
    d2 = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for found in (vx.nearest_words(table(spark, x), table(spark, c, "word"), 3), vx.nearest_words_in_blocks(table(spark, x), table(spark, c, "word"), 3, 7)):
        got = {(r["feat_id"], r["place"]): (r["word"], r["d2"]) for r in found.collect()}
        want = np.argsort(d2, axis=1)[:, :3]
        assert all(got[i, k + 1][0] == want[i, k] and abs(got[i, k + 1][1] - d2[i, want[i, k]]) < 1e-9 for i in range(300) for k in range(3))


def test_ratio_matches(spark):
    left, right = [[0, 0], [5, 5]], [[0, 0.1], [3, 3], [5, 4.5], [5, 5.6]]
    assert sorted((r["a"], r["b"]) for r in vx.ratio_matches(table(spark, left), table(spark, right)).collect()) == [(0, 0), (1, 2)]


def test_signature_bits_are_strict_and_first_is_highest(spark):
    row = spark.range(1).select(vx.signature(F.array(F.lit(1.0), F.lit(0.0), F.lit(2.0)), F.array(F.lit(0.5), F.lit(0.0), F.lit(1.0))).alias("s")).first()
    assert row["s"] == 0b101


def test_root_normalisation(spark):
    row = spark.range(1).select(vx.root_normalised(F.array(F.lit(1.0), F.lit(3.0), F.lit(-0.0))).alias("r"), vx.root_normalised(F.array(F.lit(0.0))).alias("z")).first()
    assert np.allclose(row["r"], [0.5, 0.75**0.5, 0]) and row["z"] == [0.0]


def test_kmeans_is_lloyds_iteration(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 0.1, (50, 2)), rng.normal(5, 0.1, (50, 2))]
    rows = table(spark, x)
    start = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("feat_id", F.lit(9971)), "feat_id").limit(4).collect()])
    for _ in range(3):
        near = ((x[:, None] - start[None]) ** 2).sum(axis=2).argmin(axis=1)
        start = np.array([x[near == k].mean(axis=0) if (near == k).any() else np.zeros(2) for k in range(4)])
    got = training.kmeans(rows, 4, 3).orderBy("word").collect()
    assert np.allclose([r["vec"] for r in got], start)


def test_rotation_is_orthonormal(spark):
    x = np.random.default_rng(3).standard_normal((200, 8))
    m = np.array(training.rotation(table(spark, x).withColumnRenamed("vec", "residual"), 4))
    assert np.allclose(m @ m.T, np.eye(4))


def test_vocabulary_sizes():
    assert training.vocabulary_size(18_000_000) == (100_000, 10) and training.vocabulary_size(99_999) == (1000, 5) and training.vocabulary_size(300_000) == (1100, 5) and training.vocabulary_size(17_000_000 * 2) == (100_000, 10)


def test_perfect_ranking_ignores_and_repeats(spark):
    ranking = spark.createDataFrame([(1, 9, 1), (1, 5, 2), (1, 5, 3), (1, 6, 4), (1, 7, 5)], "query_id bigint, doc_id bigint, rank int")
    truth = spark.createDataFrame([(1, 9, "ign"), (1, 5, "pos"), (1, 6, "pos"), (2, 5, "pos")], "query_id bigint, doc_id bigint, kind string")
    assert {r["query_id"]: r["ap"] for r in evaluate.average_precision(ranking, truth).collect()} == {1: 1.0, 2: 0.0}
    assert [r["recall"] for r in evaluate.recall_at(ranking, truth, 2).orderBy("at").collect()] == [0.5, 0.5]


def test_objects_by_place(spark):
    places = spark.createDataFrame([(0, 0.0, 0.0), (1, 24.0, 3.0), (2, 30.0, 0.0)], "doc_id bigint, x double, y double")
    got = {r["doc_id"]: r["object_id"] for r in evaluate.objects_by_place(places).collect()}
    assert got[0] == got[1] != got[2]
    assert evaluate.objects_by_place(places, repeat=24).count() == 72
