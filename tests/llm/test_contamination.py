import random

import pytest

from findlode.llm import contamination
from tests.llm.test_textscan import brute_shingles

ITEM = "item_id bigint, text string"


def brute(docs, items, percent=75):
    out = set()
    for i, q in items:
        q = brute_shingles(q)
        for d, t in docs:
            n = len(q & brute_shingles(t))
            if n and 100 * n >= percent * len(q):
                out.add((d, i, n, len(q)))
    return out


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def case(odd):
    rng = random.Random(8)
    items = [(k, " ".join(words(rng, rng.choice([2, 4, 5, 6, 9, 14, 30, 31, 70, 200, 900])))) for k in range(60)]
    items += [(100, None), (101, ""), (102, items[5][1]), (None, items[6][1])]
    docs = list(odd)
    for k, (_, item) in enumerate(items[:60]):
        own = item.split()
        for cut in (0, 1, len(own) // 6, len(own) // 4, len(own) // 3):
            part = own[: len(own) - cut]
            docs.append(" ".join(words(rng, rng.choice([0, 3, 200, 2000])) + [w.upper() if k % 2 else w for w in part] + words(rng, rng.choice([0, 50]))))
        if len(own) > 20:  # in two places, and with a word in the middle replaced
            docs.append(" ".join(own[: len(own) // 2] + words(rng, 300) + own[len(own) // 2 :]))
            docs.append(" ".join(words(rng, 100) + [*own[: len(own) // 2], "other", *own[len(own) // 2 + 1 :]]))
    return list(enumerate(docs)), items


@pytest.mark.parametrize("block", [20_000, 17])
def test_all_held_items_are_found_and_no_others(spark, docs_of, case, block):
    docs, items = case
    got = contamination.contaminated(docs_of(docs, extra=True), spark.createDataFrame(items, ITEM), block_items=block).collect()
    assert {tuple(r)[:4] for r in got} == brute(docs, items)
    assert all(r["containment"] == r["shared"] / r["item_shingles"] for r in got)


def test_filter_keeps_all_others_whole(spark, docs_of, case):
    docs, items = case
    table = docs_of(docs, extra=True)
    kept = contamination.without_items(table, spark.createDataFrame(items, ITEM), block_items=40)
    assert kept.schema == table.schema
    hit = {d for d, *_ in brute(docs, items)}
    assert sorted(r["doc_id"] for r in kept.collect()) == [d for d, _ in docs if d not in hit]


def test_empty_tables_nulls_and_repeats(spark, docs_of):
    one = spark.createDataFrame([(1, "a b c d e f")], ITEM)
    assert contamination.contaminated(docs_of(["x"]).limit(0), one).count() == 0
    assert contamination.contaminated(docs_of(["x"]), one.limit(0)).count() == 0
    assert contamination.without_items(docs_of(["a b c d e f"]), one.limit(0)).count() == 1
    rows = contamination.contaminated(docs_of([(None, "a b c d e f g"), (2, "a b c d e f"), (2, "a b c d e f")]), one).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["2", "2", "None"]
