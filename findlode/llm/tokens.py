"""Token ids of whole texts by a tokenizers file, fast enough for a corpus.

A byte-level vocabulary never merges across the start of " x", a single space between two characters that aren't white
space. Texts are cut at such places, each distinct cut is encoded once per worker and remembered, and what is remembered
is put together again: the ids are those of the whole text. Other white space is never a place to cut. A cut of letters
alone is one word to the pre-tokenizer, and goes to the vocabulary's model directly.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Callable

import numpy as np

#: Cuts remembered per worker: those met again, and new ones. A full memory starts anew.
REMEMBERED = 500_000
NEW = 300_000
#: First words of lines, and runs of marks, remembered beside them.
HEADS = 50_000
#: ASCII marks; an apostrophe may begin a contraction and isn't among them.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> str:
    """How byte-level vocabularies write the 256 bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(others)) for b in range(256))


class _Memory(dict):
    """Cuts met at least twice; a cut met for the second time moves over from ``new``."""

    def __init__(self, learn: Callable[[str], bytes | None]) -> None:
        super().__init__()
        self.learn = learn
        self.new: dict[str, bytes | None] = {}

    def __missing__(self, cut: str) -> bytes | None:
        if cut in self.new:
            ids = self[cut] = self.new.pop(cut)
        else:
            ids = self.new[cut] = self.learn(cut)
        return ids

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.new) > NEW:
            self.new.clear()


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(f"<u{array(self.code).itemsize}")
        letters = _byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.space = letters[32]
        self.heads: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.newline = self._whole("\n")
        self.memory = _Memory(self._cut)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str, space: str) -> bytes:
        written = word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(space + written)]).tobytes()

    def _word(self, word: str, space: str) -> bytes:
        """The ids of a cut's part without white space, with or without a space before it.

        Letters and the marks after them are separate to the pre-tokenizer; both are often known by themselves.
        """
        bare = word.rstrip(MARKS)
        if not bare.isalpha():
            return self._whole((space and " ") + word)
        if space:
            known = self.memory.get(bare) or self.memory.new.get(bare) or self._letters(bare, space)
        else:
            known = self.heads.get(bare)
            if known is None:
                if len(self.heads) > HEADS:
                    self.heads.clear()
                known = self.heads[bare] = self._letters(bare, space)
        if len(bare) == len(word):
            return known
        marks = word[len(bare) :]
        ids = self.marks.get(marks)
        if ids is None:
            if len(self.marks) > HEADS:
                self.marks.clear()
            ids = self.marks[marks] = self._whole(marks)
        return known + ids

    def _cut(self, cut: str) -> bytes | None:
        """The ids of " cut"; none if that isn't a place to cut."""
        if not cut or cut[0].isspace() or cut[-1].isspace():
            return None
        if "\n" not in cut:
            return self._word(cut, self.space)
        head, *lines = cut.split("\n")
        if any(not x or x[0].isspace() or x[-1].isspace() for x in (head, *lines)):
            return self._whole(" " + cut)
        return self.newline.join([self._word(head, self.space), *(self._word(x, "") for x in lines)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        self.memory.trim()
        get = self.memory.__getitem__
        out = []
        for text in texts:
            parts = text.split(" ")
            head = parts[0]
            try:
                ids = (self._whole(head) if head and not head[-1].isspace() else None) + b"".join(map(get, parts[1:]))
            except TypeError:  # a None: a space with white space, or nothing, beside it
                ids = self._odd(text)
            out.append(np.frombuffer(ids, self.dtype))
        return out

    def _odd(self, text: str) -> bytes:
        """A text with odd white space: cut only at spaces with a visible character on both sides."""
        head, *cuts = re.split(r"(?<=\S) (?=\S)", text)
        return b"".join([self._whole(head), *(self._cut(c) or self._whole(" " + c) for c in cuts)])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's own encoder of a file."""
    return Encoder(path)


def release() -> None:
    """Lets go of the worker's encoders and what they remember: other work needs the memory."""
    encoder.cache_clear()
