"""Exact and fast encoding with a byte-level BPE file of the tokenizers library.

A byte-level BPE splits a text before it merges anything, and always splits it in front of a space that a character
other than white space follows, and around a single line end between two such characters. So a text's ids are those of
its words put together, and the library needs to encode each different word only once; the words' ids are kept as bytes.
A word of letters alone is one piece before merging, so the library's BPE model gets it without the splitting around it.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

#: So many different words are kept in a worker, whatever their kind, then it starts anew.
KEEP_WORDS = 300_000
_CUT = re.compile(r"(?= \S)")


_LATIN_END = "\u0250"  # up to here all versions of Unicode agree on what a letter is


_MARKS = ".,;:!?|#*$%&)"


def _byte_letters() -> dict[int, str]:
    """The character that byte-level BPE writes for each byte, by its Latin-1 code point."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class _Kept(dict):
    """From a word (for tails: the word after its space) to its ids as bytes."""

    def __init__(self, encode, before: str = ""):
        super().__init__()
        self.encode, self.before = encode, before
        self.ends: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(_MARKS)
        if stem != word and stem.isalpha() and max(stem) < _LATIN_END:  # marks after letters are a piece of their own
            marks = word[len(stem) :]
            if marks not in self.ends:
                self.ends[marks] = self.encode(marks)
            got = (self.get(stem) or self.encode(self.before + stem)) + self.ends[marks]
        else:
            got = self.encode(self.before + word)
        self[word] = got
        return got


class Encoder:
    def __init__(self, path: str, keep_words: int = KEEP_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.keep_words = keep_words
        self.heads, self.tails, self.chunks = _Kept(self._ids), _Kept(self._ids, " "), _Kept(self._ids)
        self.line_end = self._ids("\n")

    def _ids(self, text: str) -> bytes:
        letters = text.removeprefix(" ")
        if letters.isalpha():
            if letters.isascii():
                return self._bytes([x.id for x in self.model.tokenize(text.replace(" ", _LETTERS[32]))])
            if max(letters) < _LATIN_END:
                return self._bytes([x.id for x in self.model.tokenize(text.encode().decode("latin-1").translate(_LETTERS))])
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _bytes(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def raw(self, text: str | None) -> bytes:
        """The text's ids, as bytes of self.kind; null has none."""
        if not text:
            return b""
        if len(self.heads) + len(self.tails) + len(self.chunks) > self.keep_words:
            for kept in (self.heads, self.tails, self.chunks):
                kept.clear()
                kept.ends.clear()
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0].isspace() or text[-1].isspace() or sum(map(len, text.split())) + text.count(" ") + text.count("\n") < len(text):
            return b"".join(map(self.chunks.__getitem__, _CUT.split(text)))
        tail, lines = self.tails.__getitem__, []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            lines.append(self.heads[head] + b"".join(map(tail, rest)))
        return self.line_end.join(lines)

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), self.kind)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
