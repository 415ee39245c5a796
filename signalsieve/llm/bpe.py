"""BPE encoding and decoding with a vocabulary file of the ``tokenizers`` library.

A word's symbols form a doubly linked list; a priority queue holds the ranks of adjacent pairs. The
best pair is merged and its new neighbours are queued; entries whose pair is gone are skipped when
they come up. Decoding joins the vocabulary's strings. Words repeat, so each worker keeps the ids of those
seen lately, in caches of bounded size. Strings are not kept with them, as a text's own ids give them.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from signalsieve.llm.common import importable
from signalsieve.llm.token_ids import BatchCache, pieces_of
from signalsieve.llm.words import byte_characters, has_known_patterns, split_words

#: Words, and runs without white space, per generation of a worker's caches.
CACHED = 250_000


class Bpe:
    """One vocabulary, from the text of its file."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model = parsed["model"]
        if not has_known_patterns(parsed) or parsed.get("decoder") is not None:
            raise ValueError("not a byte-level BPE with the words known here")
        vocabulary: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.strings.update({i: s for s, i in self.special.items()})
        end = model["end_of_word_suffix"] or ""
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocabulary[a] << 32 | vocabulary[b]] = (rank, vocabulary[a + b])
        characters = byte_characters()
        self.inner = [vocabulary.get(c) for c in characters]
        self.last = [vocabulary.get(c + end) for c in characters]
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._words, self._pieces = BatchCache(self._word_ids, CACHED), BatchCache(self._piece_ids, CACHED)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the pre-tokenizer."""
        data = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        symbols = [s for s in symbols if s is not None]
        n, merges = len(symbols), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry is rank and place in one number; it is stale unless the pair there has that rank.
        queue = []
        for i in range(n - 1):
            pair = merges.get(symbols[i] << 32 | symbols[i + 1])
            if pair is not None:
                queue.append(pair[0] << 32 | i)
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            pair = merges.get(symbols[i] << 32 | symbols[j])
            if pair is None or pair[0] != entry >> 32:
                continue
            symbols[i], symbols[j] = pair[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = merges.get(symbols[i] << 32 | symbols[k])
                if pair is not None:
                    heappush(queue, pair[0] << 32 | i)
            h = before[i]
            if h >= 0:
                pair = merges.get(symbols[h] << 32 | symbols[i])
                if pair is not None:
                    heappush(queue, pair[0] << 32 | h)
        return [s for s in symbols if s >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        """Vocabulary strings, one after the other with a space between."""
        return " ".join(map(self.strings.__getitem__, ids))

    def _word_ids(self, words: list[str]) -> list[bytes]:
        return [array("I", self.encode_word(word)).tobytes() for word in words]

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids (as bytes) of runs without white space."""
        split = [self._special.split(p) if self._special is not None and "<" in p else [p] for p in pieces]
        words = [[_own_words(part) for part in parts[::2]] for parts in split]
        get = self._words.knowing([w for parts in words for w in parts]).__getitem__
        out = []
        for parts, own in zip(split, words):
            made = [b"".join(map(get, own[0]))]
            for special, after in zip(parts[1::2], own[1:]):
                made += [array("I", [self.special[special]]).tobytes(), *map(get, after)]
            out.append(b"".join(made))
        return out

    def encode_texts(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Ids (as bytes) and decoded string of each text."""
        split = [pieces_of(t) for t in texts]
        get, out = self._pieces.knowing(split).__getitem__, []
        for pieces in split:
            ids = array("I", b"".join(map(get, pieces)))
            out.append((ids.tobytes(), self.decode(ids)))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_texts([text])[0][0], dtype="<i4").tolist()


def _own_words(text: str) -> list[str]:
    """Words of a text; one that is the whole text is that very string, so that both caches hold it once."""
    words = split_words(text)
    return [text] if words == [text] else words


_models: dict[str, Bpe] = {}


def model_of(spec: str) -> Bpe:
    """The vocabulary with this text; a worker keeps the latest one, with its words."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = Bpe(spec)
    return _models[key]


def list_array(parts: list[bytes]) -> pa.ListArray:
    """Lists of 32-bit integers from their bytes."""
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def _encoded_batches(spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(spec.value)
        for batch in batches:
            kept = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            texts = batch.column("text")
            for start in range(0, batch.num_rows, 256):
                coded = model.encode_texts(texts.slice(start, 256).to_pylist())
                ids, decoded = list_array([c[0] for c in coded]), pa.array([c[1] for c in coded], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(start, 256) for c in kept.values()), ids, decoded], names=[*kept, "ids", "decoded"]
                )

    return run


def encode_documents(docs: DataFrame, spec: str) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``ids`` (array of int) and ``decoded``.

    ``spec`` is the text of the vocabulary's file; it is sent to the workers, whose size it does
    not outgrow. A null or empty text has no ids and decodes to the empty string. Special tokens'
    strings in a text become their ids. Columns named ids or decoded are replaced.

    Rows are encoded by themselves: repeated rows and equal texts give a row each, nulls in other columns stay,
    and a table without rows gives none. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    importable(spark)
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ("ids", "decoded")))
    kept = docs.drop("text")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes), "ids array<int>", "decoded string"])
    return docs.mapInArrow(_encoded_batches(spark.sparkContext.broadcast(spec)), schema)
