import numpy as np
import pytest
from pyspark.sql import functions as F

from findlode.llm import cotrain

LABEL = "doc_id bigint, quality int"


def test_scores_part_good_from_bad_on_the_tables(spark, small):
    """Held-out labels: a third is hidden from the fit. Both views hand on, and both together are no worse than either."""
    larger = small.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    hidden = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0
    model = cotrain.fit(docs, labels.filter(~hidden))
    given = {(i, side): 0 for i in (0, 1) for side in (0, 1)}
    for _, i, side, n in model.handed:
        given[i, side] += n
    assert all(n > 0 for n in given.values()), given
    assert min(model.mixture[:2]) >= 0 and min(a for a, _ in model.calibration) >= 0
    y = {r["doc_id"]: r["quality"] for r in labels.filter(hidden).collect()}
    rows = cotrain.quality_scores(docs, labels, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    right = {c: np.mean([(r[c] >= 0.5) == bool(y[r["doc_id"]]) for r in rows if r["doc_id"] in y]) for c in ("p_content", "p_metadata", "score")}
    assert right["score"] >= 0.98 and right["score"] >= max(right.values()) - 0.01, right


def plain_fit(rows, labels, rounds, handed):
    """Co-training said plainly, over rows of (doc_id, hash, content, meta) and {doc_id: label}; all in memory."""
    order = [r[0] for r in sorted(rows, key=lambda r: labels["turn"][r[0]]) if r[0] in labels["y"]]
    by = {r[0]: r for r in rows}
    sample = [(d, labels["y"][d], 1.0, by[d][2], by[d][3]) for d in order]
    aside, told = sample[::5], [[r for i, r in enumerate(sample) if i % 5] for _ in (0, 1)]
    views = (cotrain.View(), cotrain.View())

    def logit(i, keys):
        return sum(views[i].weights[k] for k in keys) / max(1, len(keys)) ** 0.5 + views[i].bias

    kept = cotrain.Sample.of(aside)
    for k in range(rounds + 1):
        for i in (0, 1):
            cotrain.train(views[i], i, cotrain.Sample.of(told[i]))
        if k == rounds:
            break
        pool = [r for r in rows if r[0] not in labels["y"]]
        z = [{r[0]: logit(i, r[2 + i]) for r in pool} for i in (0, 1)]
        for i in (0, 1):
            a, b = cotrain.line(np.array([logit(i, r[3 + i]) for r in aside]), kept.y, cotrain.balanced(kept.y))
            before, found = {r[0] for r in told[1 - i]}, {}
            for side in (1, 0):
                ranked = sorted(pool, key=lambda r: (round(-z[i][r[0]] if side else z[i][r[0]], 9), labels["tie"][r[0]]))
                some = [(r[0], cotrain.sigmoid(np.array(a * z[i][r[0]] + b)).item()) for r in ranked[: handed * (k + 1)]]
                found |= dict([(d, (float(side), abs(2 * p - 1))) for d, p in some if (p > 0.5 if side else p < 0.5) and d not in before][:handed])
            told[1 - i] += [(d, *found[d], by[d][2], by[d][3]) for d in sorted(found, key=lambda d: labels["turn"][d])]
    return views


def test_the_fit_is_that_of_a_plain_loop(spark, docs_of):
    rng = np.random.default_rng(3)
    good, bad = [f"good{i}" for i in range(30)], [f"bad{i}" for i in range(30)]
    texts = [" ".join(rng.choice(good if i % 3 else bad, 12)) + f" own{i}" for i in range(240)]
    docs = docs_of(texts).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("g"), F.col("doc_id") % 7)).otherwise(F.concat(F.lit("b"), F.col("doc_id") % 5)))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 60)], LABEL)
    model = cotrain.fit(docs, labels, rounds=2, handed=6)
    rows = [tuple(r) for r in cotrain.keyed(docs).collect()]
    # Ties go by hashes of the id; those within a task and those between tasks are Spark's and numpy's own.
    turn = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(17))).collect()}
    tie = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(29))).collect()}
    views = plain_fit(rows, {"y": {i: float(i % 3 > 0) for i in range(60)}, "turn": turn, "tie": tie}, 2, 6)
    assert sum(n for *_, n in model.handed) > 20
    for i in (0, 1):
        mine = [model.views[i].logits((np.zeros(len(r[2 + i]), np.int64), np.array(r[2 + i])), 1)[0] for r in rows]
        plain = [views[i].logits((np.zeros(len(r[2 + i]), np.int64), np.array(r[2 + i])), 1)[0] for r in rows]
        assert np.corrcoef(mine, plain)[0, 1] > 0.99 and np.mean((np.array(mine) > 0) == (np.array(plain) > 0)) > 0.98


def test_a_view_learns_from_the_other(spark, docs_of):
    """Content has words that no labelled row has; metadata tells the classes apart everywhere and passes it on."""
    rng = np.random.default_rng(1)
    n = 600
    truth = rng.integers(0, 2, n)
    texts = [f"same text number{i}" if i < 60 else f"{'upper' if truth[i] else 'lower'} text number{i}" for i in range(n)]
    sides = spark.createDataFrame([(i, f"s{truth[i]}") for i in range(n)], "d bigint, s string")
    docs = docs_of(texts).join(sides, F.col("doc_id") == F.col("d")).select("doc_id", "text", "lang", F.col("s").alias("source"), "n_chars")
    labels = spark.createDataFrame([(i, int(truth[i])) for i in range(60)], LABEL)
    rows = [r for r in cotrain.quality_scores(docs, labels, cotrain.fit(docs, labels, handed=100)).collect() if r["doc_id"] >= 60]
    z = [cotrain.fit(docs, labels, rounds=r, handed=100) for r in (0, 2)]
    keys = {r["doc_id"]: np.array(r["content"]) for r in cotrain.keyed(docs).collect()}
    right = [np.mean([(m.views[0].logits((np.zeros(len(keys[i]), np.int64), keys[i]), 1)[0] > 0) == truth[i] for i in range(60, n)]) for m in z]
    assert right[1] > 0.95 and right[0] < 0.7
    assert np.mean([r["kept"] == bool(truth[r["doc_id"]]) for r in rows]) > 0.95


def test_copies_of_a_text_are_handed_on_once(spark, docs_of):
    texts = [f"good words {i} here" if i % 2 else f"*** %%% {i} $$$" for i in range(80)] + ["good words 1 here"] * 200 + [f"good words {i} there" for i in range(80, 120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], LABEL)
    model = cotrain.fit(docs_of(texts), labels, rounds=1, handed=30)
    assert [n for _, i, side, n in model.handed if (i, side) == (0, 1)][0] > 10


def test_calibrated_views_follow_the_frequencies():
    rng = np.random.default_rng(2)
    x = rng.standard_normal(4000)
    y = (rng.random(4000) < cotrain.sigmoid(2 * x - 1)).astype(float)
    a, b = cotrain.line(x, y)
    assert abs(a - 2) < 0.25 and abs(b + 1) < 0.2
    assert cotrain.line(-x, y)[0] == 0
    other = rng.standard_normal(4000)
    y = (rng.random(4000) < cotrain.sigmoid(2 * x - other)).astype(float)
    mixed = cotrain.logistic(np.c_[x, other], y)
    assert mixed[0] > 1.2 and mixed[1] == 0


@pytest.mark.parametrize("labels", [[], [(0, 1)], [(0, 1), (1, 1)], [(0, None), (None, 1), (1, 0), (1, 1), (2, 5)]])
def test_too_few_labels_leave_scores_open(spark, docs_of, odd, labels):
    rows = cotrain.quality_scores(docs_of(odd, extra=True), spark.createDataFrame(labels, LABEL)).collect()
    assert len(rows) == len(odd) and {r["score"] for r in rows} == {0.5}


def test_odd_texts_nulls_repeats_and_empty_tables(spark, docs_of, odd):
    good = [f"a good text number {i} with words of sense and order" for i in range(60)]
    bad = [f"*** %%% ### {i} $$$ &&& ***" for i in range(60)]
    docs = docs_of([*good, *bad, *odd], extra=True)
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(60 + i, 0) for i in range(60)], LABEL)
    rows = {r["doc_id"]: r for r in cotrain.quality_scores(docs, labels).collect()}
    assert all(rows[i]["kept"] for i in range(60)) and not any(rows[60 + i]["kept"] for i in range(60))
    assert len(rows) == 120 + len(odd)
    again = cotrain.quality_scores(docs_of([(None, "a"), (1, "a"), (1, "a")]), labels).collect()
    assert len(again) == 3
    assert cotrain.quality_scores(docs.limit(0), labels).count() == 0
    # Two texts share every doc_id: the same one is learned from each time, and each gets its score.
    mixed = docs_of([(i % 120, t) for i, t in enumerate([*good, *bad, *bad, *good])])
    first, second = (sorted((r["doc_id"], r["score"]) for r in cotrain.quality_scores(d, labels).collect()) for d in (mixed, mixed.repartition(5)))
    assert len(first) == 240 and np.allclose(first, second, atol=1e-6)
