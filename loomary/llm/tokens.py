"""Token ids of whole texts by the tokenizers library, with a memory of chunks.

The tokenizer splits at white space and drops it, so the ids of a text are those of its chunks between spaces and line
ends, one after the other. A chunk of Latin letters with closing punctuation is the word's ids, then the punctuation's;
the word goes to the library's BPE model as the tokenizer's own steps would hand it over (lower case, bytes as
characters). All other chunks go through the whole tokenizer. The memory has two generations of at most GENERATION
bytes: when the young one is full it becomes the old one, and chunks met again move back, so frequent ones stay.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENERATION = 32 << 20
#: What an entry takes besides its characters and ids: two objects and its share of the table.
ENTRY = 190
TAILS = 1000


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level BPE vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


class ChunkTokenizer:
    """encode(text): ids as little-endian integers of `width` bytes."""

    plain = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(string.punctuation)}]*)")

    def __init__(self, path: str, width: int = 4, generation: int = GENERATION):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.kind = self.whole.model, np.dtype(f"<u{width}")
        if width < 4 and self.whole.get_vocab_size() > 1 << 8 * width:
            raise ValueError(f"ids do not fit {width} bytes")
        self.code = next(c for c in "HIL" if array(c).itemsize == width)
        self.characters = _byte_characters()
        self.generation, self.held = generation, 0
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _ids(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _word(self, word: str) -> bytes:
        found = self.young.get(word) or self.old.get(word)
        if found is None:
            raw = word if word.isascii() else word.encode().decode("latin-1").translate(self.characters)
            found = self._ids([t.id for t in self.model.tokenize(raw)])
        return found

    def _tail(self, tail: str) -> bytes:
        found = self.tails.get(tail)
        if found is None:
            if len(self.tails) > TAILS:
                self.tails = {"": b""}
            found = self.tails[tail] = self._ids(self.whole.encode(tail, add_special_tokens=False).ids)
        return found

    def _parts(self, chunk: str) -> tuple[str, str] | None:
        """A word of Latin letters and the punctuation after it; None for any other chunk."""
        if chunk.isascii():
            word = chunk.rstrip(string.punctuation)
            return (word, chunk[len(word) :]) if word.isalpha() else None
        m = self.plain.fullmatch(chunk)
        return (m[1], m[2]) if m else None

    def _learn(self, new: set[str]) -> None:
        """Put the ids of all chunks in `new` into the young generation."""
        young, old, rest = self.young, self.old, []
        again = [c for c in new if c in old]
        young.update(zip(again, map(old.__getitem__, again), strict=True))
        for chunk in new.difference(again) if again else new:
            parts = self._parts(chunk)
            if parts is None:
                rest.append(chunk)
            elif parts[1]:
                young[chunk] = self._word(parts[0].lower()) + self._tail(parts[1])
            else:
                young[chunk] = self._word(parts[0].lower())
        if rest:
            for chunk, got in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                young[chunk] = self._ids(got.ids)
        self.held += ENTRY * len(new) + sum(map(len, new)) + sum(map(len, map(young.__getitem__, new)))

    def encode(self, text: str | None) -> bytes:
        parts = (text or "").replace("\n", " ").split(" ")
        if new := set(parts).difference(self.young):
            if self.held > self.generation:
                self.young, self.old, self.held = {"": b""}, self.young, 0
                new = set(parts)
                new.discard("")
            self._learn(new)
        return b"".join(map(self.young.__getitem__, parts))


_LOADED: dict[tuple[str, int], ChunkTokenizer] = {}


def tokenizer(path: str, width: int = 4) -> ChunkTokenizer:
    """One per Python worker."""
    if (path, width) not in _LOADED:
        _LOADED[path, width] = ChunkTokenizer(path, width)
    return _LOADED[path, width]


def token_ids(text: Column, path: str, end: int | None = None, width: int = 4) -> Column:
    """Binary column: the ids of the whole text (null: none), then `end` if given, as little-endian unsigned integers."""

    @F.pandas_udf(T.BinaryType())
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = tokenizer(path, width)
        close = b"" if end is None else int(end).to_bytes(width, "little")
        for part in texts:
            yield pd.Series([own.encode(x) + close for x in part], dtype=object)

    return ids(text)
