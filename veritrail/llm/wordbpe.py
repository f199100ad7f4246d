"""Token ids of a word-splitting BPE vocabulary, with the words' ids remembered.

The vocabulary's tokenizer lower-cases, cuts a text into words by a pattern and merges inside words only, so a
text's ids are its words' ids in order. For texts of characters below U+0180 (where its normal form changes
nothing but case and white space) words are cut here and each distinct word is encoded once; every other text,
and one that spells out a special token, goes through the tokenizer whole. Both ways give its ids exactly.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

#: Words a worker remembers; words that come later are encoded each time.
REMEMBERED = 1_000_000
#: Latin letters up to here have their lower case in the same range, but for U+0130.
_SIMPLE_END = 0x180


def _class(prefix: str) -> str:
    return re.escape("".join(c for c in map(chr, range(_SIMPLE_END)) if unicodedata.category(c).startswith(prefix)))


_LETTERS, _NUMBERS = _class("L"), _class("N")
#: The vocabulary's own pattern, its classes written out for the simple range.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_NOT_SIMPLE = re.compile(rf"[^\x00-{chr(_SIMPLE_END - 1)}]|[\x00-\x08\x0e-\x1f\x7fİ]|<\|")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable Latin, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_BYTES = _byte_letters()


class WordEncoder(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, word: str) -> bytes:
        letters = word if word.isascii() else "".join([_BYTES[b] for b in word.encode()])
        ids = np.array([t.id for t in self.model.tokenize(letters)], dtype="<u4").tobytes()
        if len(self) < REMEMBERED:  # frequent words come early
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _NOT_SIMPLE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, _WORDS.findall(text.lower())))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
