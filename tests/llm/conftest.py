from __future__ import annotations

import pytest

WIDE = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from (doc_id, text) pairs; the first columns clash with names that operators use inside."""

    def make(rows, extra=False):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(d, t, "en", f"s{(d or 0) % 3}", len(t) if t is not None else None) for d, t in rows]
        if not extra:
            return spark.createDataFrame(full, WIDE)
        return spark.createDataFrame([("x", 1, 2, *r, "TEXT", 7, 8) for r in full], "added string, comp bigint, region bigint, " + WIDE + ", `TEXT` string, sig bigint, k bigint")

    return make


@pytest.fixture(scope="session")
def rows_of():
    """The result as a dictionary by doc_id."""

    def collect(df):
        return {r["doc_id"]: r.asDict() for r in df.collect()}

    return collect


#: Texts that every operator must take: null, empty, white space, one word, marks, a very long word, a long text, other scripts.
ODD = [None, "", " \n\t ", "one", "*** %%% ###", "x" * 300_000, "many words here now " * 20_000, "日本語 テスト é ü ñ", "a\x00b c", "one"]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
