import re
from collections import Counter

import pytest

from findlode.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    n, chars, marks, dup = len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))
    failed = n < 10 or 100 * len(repeated) > 20 * n
    letters = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", w)) for w in words)
    digits = sum(bool(re.search("[0-9]", w)) for w in words)
    most = max(Counter(words).values(), default=0)
    kept = not (failed or 10 * marks > n or chars < 2 * n or chars > 15 * n or 10 * dup > 5 * len(lines) or 10 * letters < 5 * n or 10 * digits > 5 * n or 10 * most > 3 * n)
    return {"n_words": n, "word_chars": chars, "n_symbols": marks, "n_dup_lines": dup, "n_repeat_words": len(repeated), "base_failed": failed, "kept": kept}


TEXTS = [
    "a plain text of more than ten words that nobody would want to lose at all",
    "the same line of words\nthe same line of words\nanother line\n\nthe same line of words ",
    "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z",
    "# * $ % & | < > [ ] ten words are needed here, so here they are now",
    "12 34 56 78 90 12a 34b 56c 78d 90e 11 22 33",
    " ".join(["same"] * 3 + [f"w{'abcdefghijk'[i]}" for i in range(8)]),
    "é ü ñ ß ç ø å æ þ ð œ ł",
]


@pytest.mark.parametrize("extra", [False, True])
def test_figures_and_verdicts_are_those_of_a_plain_count(docs_of, rows_of, odd, extra):
    texts = TEXTS + odd
    got = rows_of(quality.quality_rules(docs_of(texts, extra)))
    for i, t in enumerate(texts):
        want = brute(t)
        assert {k: got[i][k] for k in want} == want, i


def test_order_changes_the_cost_and_not_the_verdict(docs_of, rows_of):
    docs = docs_of(TEXTS)
    results = [rows_of(quality.quality_rules(docs, order=o)) for o in (quality.RULES, quality.RULES[::-1])]
    assert results[0] == results[1]


def test_the_order_goes_by_rejections_per_cost(docs_of):
    import numpy as np

    slow = quality.Rule("slow", lambda t, r: (sum(range(200_000)) < 0) | np.ones(len(r), bool))
    never = quality.Rule("never", lambda t, r: np.zeros(len(r), bool))
    quick = quality.Rule("quick", lambda t, r: np.ones(len(r), bool))
    order = quality.cascade_order(docs_of([TEXTS[0]] * 40), (slow, never, quick))
    assert [r.name for r in order].index("quick") < [r.name for r in order].index("slow")
    assert [r.name for r in order].index("quick") < [r.name for r in order].index("never")


def test_later_rules_do_not_see_what_earlier_ones_reject(docs_of):
    import numpy as np
    import pyarrow as pa

    seen = []
    rules = (quality.Rule("all", lambda t, r: np.ones(len(r), bool)), quality.Rule("spy", lambda t, r: seen.append(len(r)) or np.zeros(len(r), bool)))
    assert not quality.verdicts(quality.Texts(pa.array(TEXTS)), rules).any() and not seen


def test_keep_good_keeps_rows_whole(docs_of, odd):
    docs = docs_of(TEXTS + odd + TEXTS, extra=True)
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    want = sorted(r["doc_id"] for r in docs.collect() if brute(r["text"])["kept"])
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_empty_table(docs_of, spark):
    empty = docs_of(["x"]).limit(0)
    assert quality.quality_rules(empty).count() == 0 and quality.keep_good(empty).count() == 0
