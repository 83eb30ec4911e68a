import random
import re

import numpy as np
import pyarrow as pa

from findlode.llm import textscan as ts

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_shingles(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_words_are_runs_without_ascii_white_space():
    texts = ["a  b\tc\nd\x0be\x0cf\rg", " x y 　", "", None, " é ü", "x"]
    buf, offsets = ts.texts(pa.array(texts))
    starts, ends, _, first = ts.words_of(buf, offsets)
    for i, t in enumerate(texts):
        own = [bytes(buf[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
        assert own == WORD.findall(lower(t or ""))


def test_hashes_are_equal_exactly_for_equal_words_wherever_they_stand(monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choices("abAB é", k=rng.randint(1, 9))).replace(" ", "") or "q" for _ in range(5000)]
    buf, offsets = ts.texts(pa.array([" ".join(words)]))
    _, _, hashes, _ = ts.words_of(buf, offsets)
    by = {}
    for w, h in zip(words, hashes.tolist()):
        assert by.setdefault(lower(w), h) == h
    assert len(set(by.values())) == len(by)


def test_long_words_and_texts_cross_pieces():
    long = "y" * (3 * ts.PIECE + 17)
    text = f"a {long} b {long} a " + "word " * 400_000
    buf, offsets = ts.texts(pa.array([text]))
    _, _, hashes, _ = ts.words_of(buf, offsets)
    assert hashes[0] == hashes[4] and hashes[1] == hashes[3] and len(set(hashes[:4].tolist())) == 3
    assert len(set(hashes[5:].tolist())) == 1 and len(hashes) == 400_005


def test_shingle_sets_have_the_size_and_overlaps_of_word_sets():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdeFG", k=rng.choice([0, 1, 3, 4, 5, 6, 40, 300]))) for _ in range(60)] + [None, "A b C d", "a B c D"]
    got, want = list(ts.shingle_sets(pa.array(texts))), [brute_shingles(t) for t in texts]
    for a, x in zip(got, want):
        assert len(a) == len(x)
        for b, y in zip(got, want):
            assert len(np.intersect1d(a, b)) == len(x & y)
