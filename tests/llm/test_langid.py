import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from findlode.llm import langid

ALPHABETS = {"aa": "abcdefgh ", "bb": "efghijkl ", "cc": "éèüöäñ abc"}


def sample(rng, lang, n):
    return "".join(rng.choices(ALPHABETS[lang], k=n))


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(3)
    return {lang: [sample(rng, lang, rng.choice([1, 2, 3, 200, 500])).encode() for _ in range(20)] + [b""] for lang in ALPHABETS}


def brute_bits(samples, text, order=3):
    """Code lengths by the definition, context by context."""
    out = []
    for lang in sorted(samples):
        counts = defaultdict(Counter)
        for s in samples[lang]:
            for i, c in enumerate(s):
                for k in range(min(i, order) + 1):
                    counts[s[i - k : i]][c] += 1
        bits = 0.0
        for i, c in enumerate(text):
            for k in range(min(i, order), -1, -1):
                own = counts.get(text[i - k : i])
                if not own:
                    continue
                total = sum(own.values()) + len(own)
                if own[c]:
                    bits -= math.log2(own[c] / total)
                    break
                bits -= math.log2(len(own) / total)
            else:
                bits += 8
        out.append(bits)
    return out


@pytest.mark.parametrize("order", [0, 1, 3])
def test_code_lengths_are_exact(samples, order, monkeypatch):
    monkeypatch.setattr(langid, "_PIECE", 64)  # so that texts cross pieces
    trees = langid.Trees(samples, order)
    rng = random.Random(4)
    texts = ["", "a", "zz top", "日本", *(sample(rng, lang, n) for lang in ALPHABETS for n in (1, 5, 130, 400))]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    got = trees.lengths(np.frombuffer(b"".join(data), np.uint8), offsets)
    for row, text in zip(got, data):
        assert np.allclose(row, brute_bits(samples, text, order), rtol=1e-5, atol=1e-3)


def test_held_out_accuracy_on_the_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.language(docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_only_text_decides_and_held_out_labels_teach_nothing(spark, docs_of):
    rng = random.Random(5)
    rows = [(i, sample(rng, lang, 300), lang, "s", 1) for i, lang in enumerate(["aa", "bb"] * 40)]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    got = {r["doc_id"]: r for r in langid.language(spark.createDataFrame(rows, kind)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, *_ in rows)
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, n) for i, t, lang, s, n in rows]
    again = {r["doc_id"]: r for r in langid.language(spark.createDataFrame(wrong, kind)).collect()}
    assert {d: tuple(r) for d, r in got.items()} == {d: tuple(r) for d, r in again.items()}


def test_copies_and_nulls_do_not_thin_out_what_is_learned_from(spark):
    rng = random.Random(6)
    few = [sample(rng, "aa", 200) for _ in range(10)]
    rows = [(i, few[i % 10], "aa") for i in range(3000)] + [(3000 + i, None, "bb") for i in range(1500)] + [(4500 + i, sample(rng, "bb", 50), "bb") for i in range(60)] + [(5000 + i, sample(rng, "cc", 20), "cc") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {}
    real, langid.Trees = langid.Trees, lambda samples, order: kept.update(samples)
    try:
        langid.learn(docs, 100)
        assert len(kept["aa"]) == 10 and len(kept["bb"]) == len({t for d, t, lang in rows if lang == "bb" and t and zlib.crc32(str(d).encode()) % 4 != 2}) and 60 < len(kept["cc"]) < 140
        langid.learn(docs, 100, sample_bytes=300)
        assert len(kept["aa"]) == 1 and len(kept["cc"]) > 1 and all(sum(map(len, texts)) <= max(300, len(texts[0])) for texts in kept.values())
        langid.learn(docs, 0)
        assert {lang: len(texts) for lang, texts in kept.items()} == {"aa": 1, "bb": 1, "cc": 1}
    finally:
        langid.Trees = real


def test_a_language_of_few_texts_in_many_rows_is_learned(spark):
    rng = random.Random(7)
    german, english = [sample(rng, "aa", 200) for _ in range(5)], [sample(rng, "bb", 200) for _ in range(500)]
    rows = [(i, german[i % 5], "aa") for i in range(20_000)] + [(20_000 + i, t, "bb") for i, t in enumerate(english)]
    trees = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert trees.languages == ["aa", "bb"]


def test_undecided_texts_nulls_and_empty_tables(docs_of, odd, spark):
    rows = [*((i, t) for i, t in enumerate(odd)), (None, "many words"), (50, "12 34 !"), (51, "Ж"), (51, "Ж")]
    got = langid.language(docs_of(rows, extra=True)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for d, t in rows:
        letters = any(c.isalpha() for c in t or "")
        assert all(r["lang_pred"] == ("en" if letters else "und") and (letters or r["score"] == 0) for r in by[d])
    assert len(by[51]) == 2 and by[None][0]["held_out"] is False
    assert langid.language(docs_of(["x"]).limit(0)).count() == 0
    unlabelled = docs_of(["some text"]).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string"))
    assert [r["lang_pred"] for r in langid.language(unlabelled).collect()] == ["und"]
