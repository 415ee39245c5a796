"""Ids of whole texts by the ``tokenizers`` library, for the operators on token files.

The library takes a text apart at white space before anything else, so a text's ids are those of
its pieces between white space. Pieces repeat; each worker keeps what it knows of those seen lately, in
two generations of bounded size, and only new ones go to the library.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from signalsieve.llm.words import byte_characters, has_known_patterns, split_words

#: Pieces per generation of a cache, and the longest one that is kept there.
CACHE_PIECES = 500_000
CACHE_LENGTH = 64

#: Characters at which Python splits and the library does not.
_PYTHON_ONLY = re.compile("[\x1c-\x1f]")
_WHITE = re.compile(r"[ \t-\r]+")


def pieces_of(text: str | None) -> list[str]:
    """Runs without white space."""
    if not text:
        return []
    return text.split() if not _PYTHON_ONLY.search(text) else [p for p in _WHITE.split(text) if p]


class Cache:
    """``make(piece)`` of pieces seen lately, ``most`` per generation and those of one call."""

    def __init__(self, make: Callable[[str], object], most: int | None = None):
        self.make, self.most = make, most or CACHE_PIECES
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.long: list[str] = []

    def knowing(self, lists: list[list[str]]) -> dict[str, object]:
        """A dictionary that has all these pieces, until the next call."""
        for piece in self.long:
            del self.young[piece]
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        new = set(chain.from_iterable(lists)).difference(self.young)
        old, make = self.old, self.make
        self.young.update([(p, old[p] if p in old else make(p)) for p in new])
        self.long = [p for p in new if len(p) > CACHE_LENGTH]
        return self.young


class BatchCache(Cache):
    """A cache that makes all new pieces of a call together: ``make`` takes and gives a list."""

    def __init__(self, make: Callable[[list[str]], list], most: int | None = None):
        super().__init__(lambda piece: make([piece])[0], most)
        self.make_all = make

    def knowing(self, lists: list[list[str]]) -> dict[str, object]:
        for piece in self.long:
            del self.young[piece]
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        new = list(set(chain.from_iterable(lists)).difference(self.young))
        old, young = self.old, self.young
        unknown = []
        for piece in new:
            if piece in old:
                young[piece] = old[piece]
            else:
                unknown.append(piece)
        young.update(zip(unknown, self.make_all(unknown)))
        self.long = [p for p in new if len(p) > CACHE_LENGTH]
        return young


class LibraryIds:
    """A tokenizer from the text of its file, without truncation and padding."""

    def __init__(self, spec: str, special_as_text: bool):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = special_as_text
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        # With the patterns that are known here, the library's model gets words at once.
        self.by_words = has_known_patterns(json.loads(spec))
        special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        # Few pieces have a character that all special tokens share; only these are searched.
        self._sign = next(iter(set(special[0]).intersection(*special[1:])), "") if special else ""
        self._letters = dict(enumerate(byte_characters()))
        self._code = {2: "H", 4: "I"}[self.kind.itemsize]
        self._words = BatchCache(self._word_ids)
        self._pieces = BatchCache(self._piece_ids)

    def _word_ids(self, words: list[str]) -> list[bytes]:
        tokenize, letters, code, out = self.tokenizer.model.tokenize, self._letters, self._code, []
        for word in words:
            if not word.isascii():
                word = word.encode("utf-8", "surrogatepass").decode("latin-1")
            out.append(array(code, [t.id for t in tokenize(word.translate(letters))]).tobytes())
        return out

    def _by_library(self, piece: str) -> bool:
        return not self.by_words or self._special is not None and self._sign in piece and self._special.search(piece) is not None

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        split = [None if self._by_library(p) else split_words(p) for p in pieces]
        get = self._words.knowing([s for s in split if s is not None]).__getitem__
        return [
            array(self._code, self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes() if s is None else b"".join(map(get, s))
            for p, s in zip(pieces, split)
        ]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian numbers of ``kind``; none for a null text."""
        split = [pieces_of(t) for t in texts]
        get = self._pieces.knowing(split).__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]


_models: dict[tuple, LibraryIds] = {}


def library_ids(spec: str, special_as_text: bool = False) -> LibraryIds:
    """The tokenizer of this text; a worker keeps the latest one, with its pieces."""
    key = (hashlib.sha256(spec.encode()).hexdigest(), special_as_text)
    if key not in _models:
        _models.clear()
        _models[key] = LibraryIds(spec, special_as_text)
    return _models[key]


def each(batches: Iterator[pa.RecordBatch], rows: int, use: Callable) -> Iterator[pa.RecordBatch]:
    """``use`` on slices of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield use(batch.slice(start, rows))
