import math

from findlode.operators import index, scoring

TF = "word string, doc_id bigint, tf double"


def small(spark):
    tf = spark.createDataFrame([("a", 0, 2.0), ("b", 0, 1.0), ("a", 1, 1.0), ("c", 2, 3.0)], TF)
    docs = spark.createDataFrame([(d,) for d in range(4)], "doc_id bigint")
    return tf, docs, index.idf(tf, docs, spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "word string"))


def test_idf_of_words_without_postings(spark):
    _, _, idf = small(spark)
    got = {r["word"]: r["idf"] for r in idf.collect()}
    assert got == {"a": math.log(2), "b": math.log(4), "c": math.log(4), "none": math.log(4)}


def test_tfidf_has_idf_twice_on_the_query_side(spark):
    tf, docs, idf = small(spark)
    norms = index.tfidf_norms(tf, idf)
    q = spark.createDataFrame([(7, "a", 1.0), (7, "none", 2.0)], "query_id bigint, word string, tf double")
    a, none = math.log(2), math.log(4)
    q_l2 = math.sqrt(a * a + (2 * none) ** 2)
    got = {r["doc_id"]: r["score"] for r in scoring.dense(scoring.tfidf(q, tf, idf, norms), q, docs).collect()}
    assert abs(got[1] - a * a / q_l2 / a) < 1e-12 and got[2] == got[3] == 0
    l2 = math.sqrt((2 * a) ** 2 + none**2)
    assert abs(got[0] - 2 * a * a / q_l2 / l2) < 1e-12


def test_hamming_thresholds_and_empty_words(spark):
    full = (1 << 64) - 1
    flip = lambda n: (lambda v: v - (1 << 64) if v >> 63 else v)((1 << n) - 1)
    postings = spark.createDataFrame([(1, d, d, flip(n)) for d, n in enumerate((0, 24, 25, 28, 29, 64))] + [(2, 9, 9, 0)], "word bigint, doc_id bigint, feat_id bigint, sig bigint")
    query = spark.createDataFrame([(0, 0, 1, 0), (0, 1, 3, 0), (0, 2, 3, 0)], "query_id bigint, q_feat bigint, word bigint, q_sig bigint")
    assert full and sorted(r["h"] for r in scoring.hamming_matches(query, postings, scoring.match_threshold(64)).collect()) == [0, 24]
    idf = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0)], "word bigint, idf double")
    weights = {r["doc_id"]: r["w"] for r in scoring.match_weights(query, postings, idf).collect()}
    assert weights[0] == 1 and weights[3] > 0 and weights[4] == weights[5] == -1
    norms = spark.createDataFrame([(d, 1.0) for d in range(10)], "doc_id bigint, l2 double")
    got = {r["doc_id"]: r["score"] for r in scoring.hamming(query, postings, idf, norms).collect()}
    # word 1 enters once for its feature; word 3 has two features and no posting, and enters once
    assert abs(got[0] - 1 / (1 + 4)) < 1e-12 and abs(got[1] - math.exp(-(24 / 16) ** 2) / 5) < 1e-12 and set(got) == {0, 1}


def test_outliers_by_votes(spark):
    rows = [(0, q, w, 0) for q in (1, 2, 3) for w in "abcdef"] + [(0, 4, w, 0) for w in "uvwxyz"] + [(1, q, f"w{q}", 0) for q in range(10, 15)]
    got = scoring.without_outliers(spark.createDataFrame(rows, "group_id bigint, query_id bigint, word string, q_sig bigint"))
    by = {}
    for r in got.collect():
        by.setdefault(r["group_id"], set()).add(r["query_id"])
    assert by[0] == {1, 2, 3} and by[1] == {10, 11, 12, 13, 14}


def test_combinations(spark):
    rows = spark.createDataFrame([(1, 5, 0.2), (1, 5, 0.6), (1, 5, 0.4), (1, 6, 0.3)], "group_id bigint, doc_id bigint, score double")
    get = lambda how: {r["doc_id"]: round(r["score"], 9) for r in scoring.combine(rows, how).collect()}
    assert get("max") == {5: 0.6, 6: 0.3} and get("sum") == {5: 1.2, 6: 0.3} and get("kth") == {5: 0.4, 6: 0.0}


def test_index_tools(spark):
    p = spark.createDataFrame([("a", 0), ("a", 4), ("b", 3)], "word string, doc_id bigint")
    q = spark.createDataFrame([("a", 0), ("b", 3), ("b", 3)], "word string, doc_id bigint")
    assert sorted(tuple(r) for r in index.diff(p, q).collect()) == [("a", 2, 1, 4), ("b", 1, 2, 3)]
    assert sorted(tuple(r) for r in index.every_nth(p, 4).collect()) == [("a", 0), ("a", 1)]
    moved = index.concatenated([p, q], [10, 0]).collect()
    assert sorted(r["doc_id"] for r in moved) == [0, 3, 4, 10, 13, 13]
