import random

import pytest

from findlode.llm import neardup
from tests.llm.test_textscan import brute_shingles


def brute(rows, percent=75):
    """doc_id -> (set size, smallest reachable id), by all pairs."""
    sets = {}
    for d, t in rows:
        sets.setdefault(d, brute_shingles(t))
    ids = [d for d in sets if d is not None]
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(rng, text, n):
    out = list(text)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"z{rng.randrange(10**6)}"
    return out


def check(rows, docs_of):
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs_of(rows)).collect()}
    for d, (n, comp) in brute(rows).items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (n, comp, d == comp), d


def test_groups_of_copies_near_the_threshold(docs_of, odd):
    rng = random.Random(3)
    texts = []
    for size in (2, 3, 5, 9):
        base = words(rng, 80)
        texts += [" ".join(changed(rng, base, rng.randrange(0, 4))) for _ in range(size)]
    texts += [" ".join(words(rng, 60)) for _ in range(20)] + odd + ["A b C d e f", "a B c d E f", "a b", "A B", "a b c"]
    rng.shuffle(texts)
    check(list(enumerate(texts)), docs_of)


def test_a_crowd_of_near_copies_loses_no_link(docs_of):
    """Hundreds of edits of one text: most are linked, some hang on by a single partner, some by none."""
    rng = random.Random(4)
    base = words(rng, 60)
    texts = [" ".join(changed(rng, base, rng.choice([0, 1, 1, 2, 2, 2, 3, 4]))) for _ in range(260)]
    check(list(enumerate(texts)), docs_of)


def test_blocks_of_a_crowd_lose_no_link(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 700)
    test_a_crowd_of_near_copies_loses_no_link(docs_of)


def test_a_crowd_of_forms_that_share_a_template(docs_of):
    rng = random.Random(5)
    form = words(rng, 90)
    texts = [" ".join(form + words(rng, 60)) for _ in range(60)]
    texts += [" ".join(changed(rng, texts[i].split(), 2)) for i in range(0, 60, 7)]
    check(list(enumerate(texts)), docs_of)


def test_a_crowd_of_forms_that_no_order_tells_apart_loses_no_link(docs_of, monkeypatch):
    """Forms a little below the threshold, in one region however deep it is split, with pairs above it."""
    monkeypatch.setattr(neardup, "orders", lambda *_: [[999] * 16])
    monkeypatch.setattr(neardup, "BLOCK", 32)
    rng = random.Random(6)
    form = words(rng, 120)
    texts = [" ".join(form + words(rng, 24)) for _ in range(60)]
    texts += [" ".join(changed(rng, texts[i].split(), 3)) for i in range(0, 60, 3)]
    check(list(enumerate(texts)), docs_of)


def test_a_component_is_asked_in_every_crowd_where_it_is_large_and_stays_in_the_others(spark):
    """Component 0 is large in region 1 only, 100 in region 2 only; in region 3 both are few beside others."""
    from findlode.llm.shared import Scratch

    zero, hundred, others = range(0, 60), range(100, 160), range(200, 212)
    comp = {**dict.fromkeys(zero, 0), **dict.fromkeys(hundred, 100), **{d: d for d in others}}
    regions = {1: [*zero[:30], *others[:2]], 2: [*hundred[:30], *zero[40:60]], 3: [*zero[30:50], *others]}
    crowded = spark.createDataFrame([(r, 0, 0, comp[d], d, len(own)) for r, own in regions.items() for d in own], "region bigint, t int, deep bigint, comp bigint, doc_id bigint, size bigint")
    now = spark.createDataFrame(list(comp.items()), "doc_id bigint, comp bigint")
    sets = spark.createDataFrame([(d, list(range(10)) if d in (45, 110) else [1000 * (d + 1) + i for i in range(10)]) for d in comp], "doc_id bigint, shingles array<bigint>")
    scratch = Scratch(spark, "crowd")
    found, rest = neardup.crowd_links(crowded, now, sets.selectExpr("doc_id", "size(shingles) n_shingles"), sets, scratch)
    assert {tuple(sorted(r)) for r in found.collect()} == {(45, 110)}
    left = {}
    for r in rest.collect():
        left.setdefault(r["region"], set()).add(r["doc_id"])
    assert left == {1: set(others[:2]), 2: set(zero[40:60]), 3: {*zero[30:50], *others}}
    scratch.close()


def test_extra_columns_nulls_and_repeats(docs_of, odd):
    rows = [(5, "a b c d e f g h"), (9, "a b c d e f g h"), (9, "a b c d e f g h"), (None, "a b c d e f g h"), (2, None), (None, None), *((20 + i, t) for i, t in enumerate(odd))]
    got = neardup.near_duplicates(docs_of(rows, extra=True)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by[9]] == [5, 5] and by[5][0]["kept"] and by[2][0]["n_shingles"] == 0 and by[2][0]["kept"]
    assert {r["component_id"] for r in by[None]} == {5, None}


def test_regions_cut_into_parts_lose_no_link(docs_of, monkeypatch):
    """Several hundred edits of two texts, in parts of eight documents."""
    monkeypatch.setattr(neardup, "CHAIN", 8)
    rng = random.Random(11)
    bases = [words(rng, 120) for _ in range(2)]
    texts = [" ".join(changed(rng, bases[i % 2], rng.randrange(0, 5))) for i in range(400)]
    check(list(enumerate(texts)), docs_of)


def test_one_of_each_keeps_whole_rows(docs_of):
    docs = docs_of(["a b c d e f", "x y z", "a b c d e f", None, ""], extra=True)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3, 4]


def test_empty_table(docs_of):
    assert neardup.near_duplicates(docs_of(["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 65])
def test_components_of_long_chains(spark, n):
    from findlode.llm.shared import Scratch

    scratch = Scratch(spark, "chain")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(200, 201)], "a bigint, b bigint")
    got = {r["doc_id"]: r["comp"] for r in neardup.components(links, scratch, "t").collect()}
    assert got == {i: 0 for i in range(n)} | {200: 200, 201: 200}
    scratch.close()


def test_rows_of_one_doc_id_with_different_texts(docs_of):
    one, two = "a b c d e f g h i j k l m n o p q r s t", "z y x w v u t s r q p o n m l k j i h g"
    rows = [(5, one), (5, two), (6, one + " u"), (7, two + " f"), (8, two), (9, "alone with five words here")]
    got = sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs_of(rows)).collect())
    assert got == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 5), (9, 9)]


def test_ten_thousand_forms_below_the_threshold_lose_no_pair_above_it(docs_of):
    """Forms of similarity 0.725 to each other, and 200 pairs of 0.763 among them."""
    rng = random.Random(1)
    form = words(rng, 104)
    own = [[f"w{i}x{k}" for k in range(19)] for i in range(10_000)]
    rows = [(i, " ".join(form + w)) for i, w in enumerate(own)]
    pairs = [(i, 1_000_000 + i) for i in range(0, 10_000, 50)]
    rows += [(b, " ".join(form + own[a][:3] + [f"v{b}x{k}" for k in range(16)])) for a, b in pairs]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(rows).repartition(8)).collect()}
    assert all(got[b] == a for a, b in pairs) and sum(d != c for d, c in got.items()) == len(pairs)
