import zlib
from collections import defaultdict

import numpy as np
import pytest

from findlode.llm import packing
from findlode.llm.tokens import Encoder


@pytest.fixture(scope="module")
def encoder():
    return Encoder(packing.tokenizer_path())


def plain(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


TEXTS = ["", " ", "a", " a", "a  b", "a b ", "x\n y z", "é  ü　 a b", "\n", "a \n b c", "a​ b c", "it's a 's b 'll we've", "1 2 33 a1 b2", "a\x1c b \x85 c d", "<|endoftext|> a <|endoftext|>", "᠎ a b", "  a b", "日本 語 テスト ok", "word.%%% word, (word) 'word' word...", "line one.\nLine two,\nline", "a\tb c", "naïve café", "x" * 5000, "́a b", "ǅ ⅷ ² ½ x², y½"]


def test_cuts_give_the_ids_of_the_whole_text(encoder):
    for _ in range(3):  # the later rounds come from memory
        for text, ids in zip(TEXTS, encoder.encode(TEXTS)):
            assert ids.tolist() == plain(encoder, text), text


def test_memory_may_run_full_at_any_time(encoder, monkeypatch):
    from findlode.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    monkeypatch.setattr(tokens, "NEW", 2)
    monkeypatch.setattr(tokens, "HEADS", 1)
    for text in TEXTS * 2:
        assert encoder.encode([text, text])[1].tolist() == plain(encoder, text)


def whole(pieces, sizes):
    """Pieces tile documents and sequences; returns each sequence's length."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for i, start, length, sequence, offset in pieces:
        assert length > 0
        by_doc[i].append((start, length))
        by_sequence[sequence].append((offset, length))
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == n
    out = {}
    for s, own in by_sequence.items():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        out[s] = at
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 50, 8000])
def test_sequences_are_full_or_powers_of_two(n):
    sizes = np.random.default_rng(n).integers(1, 3000, n)
    lengths = whole(packing.place(sizes), sizes.tolist())
    assert all(v & (v - 1) == 0 for v in lengths.values())
    assert len(lengths) <= -(-int(sizes.sum()) // packing.WINDOW) + 10


def test_ties_and_hot_lengths():
    for sizes in ([700] * 5000, [512] * 999, [1024] * 7, [1023, 1] * 400, [341] * 1000 + [342] * 500):
        assert all(v & (v - 1) == 0 for v in whole(packing.place(np.array(sizes)), sizes).values())


def test_least_squares_meets_a_histogram_that_combinations_can_make():
    rng = np.random.default_rng(1)
    combos = packing.combinations()
    assert (combos.sum(axis=1) == packing.WINDOW).all()
    truth = np.zeros(len(combos))
    truth[rng.choice(512, 40, replace=False)] = rng.integers(20, 200, 40)
    histogram = np.bincount(combos.ravel(), np.where(combos > 0, truth[:, None], 0).ravel(), packing.WINDOW)
    possible = ((histogram[combos] > 0) | (combos == 0)).all(axis=1)
    x = packing.solve(combos[possible], histogram)
    assert (x >= 0).all()
    counts = packing.whole_counts(combos[possible], x, histogram)
    placed = np.bincount(combos[possible].ravel(), np.where(combos[possible] > 0, counts[:, None], 0).ravel(), packing.WINDOW)
    assert (placed <= histogram).all() and placed.sum() > 0.9 * histogram.sum()


def test_pieces_hold_the_ids_of_their_documents(docs_of, encoder, odd):
    texts = TEXTS + odd + ["more words to fill a window with " * 300] * 3
    rows = [tuple(r) for r in packing.packed(docs_of(texts, extra=True), block_tokens=3000).collect()]
    by = defaultdict(list)
    sequences = defaultdict(list)
    for doc, start, length, crc, n, sequence, offset in rows:
        by[doc].append((start, length, crc, n))
        sequences[sequence].append((offset, length))
    for i, t in enumerate(texts):
        ids = np.array([*plain(encoder, t), 0], "<u4")
        at = 0
        for start, length, crc, n in sorted(by[i]):
            assert start == at and n == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for own in sequences.values():
        total = sum(length for _, length in own)
        assert total <= 1024 and total & (total - 1) == 0


def test_null_ids_repeats_and_empty_tables(docs_of):
    assert sorted((str(r["doc_id"]), r["length"]) for r in packing.packed(docs_of([(None, "a"), (1, "a"), (1, "a")])).collect()) == [("1", 2), ("1", 2), ("None", 2)]
    assert packing.packed(docs_of(["x"]).limit(0)).count() == 0
