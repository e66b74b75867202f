"""Token ids of whole texts by the tokenizers library, each different word asked for once while cached.

A word-level vocabulary drops white space before any merge, so a text's ids are those of its
white-space separated words in turn. Only ASCII white space is used to separate, which both
the library's pattern and ``bytes.split`` treat alike; everything else goes to the library.
"""

from __future__ import annotations

import functools
import re
import sys
from array import array
from collections.abc import Callable

from tokenizers import Tokenizer

WORD_BYTES, STEM_BYTES = 40 << 20, 8 << 20
# letters whose lower-case and composed forms are single letters, then one run of punctuation
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([-.,!?;:*#$%&|\"()]*)")


class Generations(dict):
    """A cache of byte strings in two generations, each of about ``limit`` bytes.

    What is used again moves from the old generation to the young one, so frequent entries
    outlive any number of rare ones. ``age`` is called between slices of work.
    """

    ENTRY = 160  # bytes of two short objects and their place in the table

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.size, self.old = make, limit, 0, {}

    def __missing__(self, key):
        if (got := self.old.get(key)) is None:
            got = self.make(key)
        self[key] = got
        self.size += len(key) + len(got) + self.ENTRY
        return got

    def age(self) -> None:
        if self.size > self.limit:
            self.old, self.size = dict(self), 0
            self.clear()


class WordIds:
    """Ids by word; a word is encoded when it is asked for and no longer known."""

    def __init__(self, path: str, word_bytes: int = WORD_BYTES, stem_bytes: int = STEM_BYTES):
        self.tok = Tokenizer.from_file(path)
        self.tokenize = self.tok.model.tokenize  # the attribute is made anew at every use
        self.words = Generations(self._word, word_bytes)
        self.stems = Generations(self._stem, stem_bytes)
        byte_level = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in byte_level]
        self.shown = {b: chr(b) for b in byte_level} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.marks = {m.encode(): self._stem(m) for m in "-.,!?;:*#$%&|\"()"}

    def _stem(self, run: str) -> bytes:
        """Ids of one run of letters or of punctuation, by the library's own merge model."""
        shown = run if run.isascii() else "".join(map(self.shown.__getitem__, run.encode()))
        return _packed([t.id for t in self.tokenize(shown)])

    def _word(self, raw: bytes) -> bytes:
        # ASCII letters, alone or before one mark: the word in small letters is what is remembered
        if raw.isalpha():
            return self._stem(raw.decode()) if raw.islower() else self.words[raw.lower()]
        if raw[-1:] in self.marks and raw[:-1].isalpha():
            return self.words[raw[:-1]] + self.marks[raw[-1:]]
        word = raw.decode()
        if m := PLAIN.fullmatch(word):
            a, b = m.groups()
            return self.stems[a.lower()] + (self.stems[b] if b else b"")
        return _packed(self.tok.encode(word, add_special_tokens=False).ids)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        self.words.age()
        self.stems.age()
        get = self.words.__getitem__
        return [b"".join(map(get, t.encode("utf-8", "replace").split())) for t in texts]


def _packed(ids: list[int]) -> bytes:
    got = array("I", ids)
    if sys.byteorder == "big":
        got.byteswap()
    return got.tobytes()


@functools.lru_cache(maxsize=2)
def word_ids(path: str, word_bytes: int = WORD_BYTES) -> WordIds:
    """One tokenizer per worker process."""
    return WordIds(path, word_bytes, min(STEM_BYTES, word_bytes // 5))
