"""Periodic runs of words by an online sparse dynamic program over diagonals.

Words are read once, in order. A diagonal is a lag; while a word's earlier occurrence lies where the last
word's did, that lag's match length grows by one, and a diagonal that ends with enough matches emits
its run at once.

Sparse: a word's earlier occurrences are those with the same words before them. A run of period p has
(repeats - 1) * p matches or more, and never fewer than ``context`` of them, so it shows with the word's
last g words as well, for any g up to that; and where g is p or more, the nearest earlier occurrence of these g
words is exactly p back, as nearer ones would give the run a smaller period. So for the lags from
g / 2 to g each word has one earlier occurrence to count, and g doubles from ``context`` on: a text
of n words takes n log n steps, also one that repeats a single word. Contexts are named exactly, by
pairs of the names of their halves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from signalsieve.llm.common import importable
from signalsieve.llm.frames import flat_bytes, text_slices

LEAST_LENGTH = 24
LEAST_REPEATS = 3


def context_words(least_length: int, least_repeats: int) -> int:
    """The fewest matches that a run of any period has."""
    return min(max(least_length - p, (least_repeats - 1) * p) for p in range(1, least_length + 1))


def _widths(width: int) -> list[int]:
    """Powers of two below ``width``, and ``width``."""
    return [*(1 << k for k in range((width - 1).bit_length())), width]


def recurring(hashes: np.ndarray, owners: np.ndarray, width: int) -> set[int]:
    """Texts in which some ``width`` words in a row may occur twice, all others surely not.

    ``hashes`` are those of the words of many texts, ``owners`` their texts' numbers, ascending.
    """
    mixed, have = hashes.astype(np.uint64), 1
    for wide in _widths(width)[1:]:
        step = wide - have
        if len(mixed) <= step:
            return set()
        factor = np.uint64(0x9E3779B97F4A7C15 + 2 * wide)
        mixed = mixed[:-step] * factor ^ (mixed[step:] + (mixed[step:] >> np.uint64(29)))
        have = wide
    whole = owners[: len(mixed)] == owners[width - 1 :]
    texts = owners[: len(mixed)][whole]
    keys = mixed[whole] ^ (texts.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    return set(texts[order[1:][same]].tolist())


class _Contexts:
    """Names of the last g words at each place of a text, for growing g."""

    def __init__(self, words: list):
        numbers: dict = {}
        self.names, self.width = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64), 1

    def widen(self, width: int) -> np.ndarray:
        """Names for ``width`` words; the first ``width - 1`` places have none."""
        for wide in _widths(width):
            if wide > self.width:
                step = wide - self.width
                pairs = self.names[:-step] * (len(self.names) + 1) + self.names[step:] if step < len(self.names) else self.names[:0]
                self.names = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
                self.width = wide
        return self.names


def runs_of(words: list, least_length: int = LEAST_LENGTH, least_repeats: int = LEAST_REPEATS) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words, by start and period."""
    if least_repeats < 3:
        raise ValueError("a run repeats its period three times at least")
    n, width = len(words), context_words(least_length, least_repeats)
    contexts, low, out = _Contexts(words), 0, []
    while low < n // least_repeats and width <= n:
        names = contexts.widen(width).tolist()
        if len(set(names)) == len(names):
            break  # nor does any wider context recur
        last: dict[int, int] = {}
        lag = matches = 0

        def close(end: int) -> None:
            length = matches + lag
            if matches and length >= max(least_length, least_repeats * lag):
                out.append((end - length, length, lag))

        for i, name in enumerate(names, width - 1):
            found = i - last.get(name, i)
            last[name] = i
            if matches and found == lag:
                matches += 1
                continue
            close(i)
            lag, matches = (found, width) if low < found <= width else (0, 0)
        close(n)
        low, width = width, 2 * width
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without each run's words after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def _found(least_length: int, least_repeats: int) -> Callable:
    width = context_words(least_length, least_repeats)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches):
            data, at = flat_bytes(rows.column("text"))
            cuts = at.tolist()
            # Bytes split at the six white-space bytes and nothing else.
            texts = [data[a:b].tobytes().split() for a, b in zip(cuts, cuts[1:])]
            counts = [len(t) for t in texts]
            hashes = np.fromiter((hash(w) for t in texts for w in t), np.int64, sum(counts))
            some = recurring(hashes, np.repeat(np.arange(len(texts)), counts), width)
            found = [runs_of(t, least_length, least_repeats) if i in some else [] for i, t in enumerate(texts)]
            kept = [b" ".join(collapsed(t, r)).decode() for t, r in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(c) for c in rows.schema.names if c != "text"),
                    pa.array(counts, pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], run_type),
                    pa.array(kept, pa.string()),
                ],
                names=[*(c for c in rows.schema.names if c != "text"), "n_words", "runs", "collapsed"],
            )

    return run


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_repeats: int = LEAST_REPEATS) -> DataFrame:
    """Periodic runs of words in each text: doc_id, n_words, runs (array of start, length, smallest
    period, by start and period), collapsed (the kept words, a space between).

    A run is a longest stretch of words of one period that has ``least_length`` words and ``least_repeats``
    (3 or more) periods or more. A word is left out if a run holds it after that run's first
    period. A null, empty or blank text has no words and no runs. Repeated rows and equal texts give
    a row each, a null doc_id stays null, a table without rows gives none; only doc_id and text
    are read, so columns of any other names do no harm. Texts of any length are read whole.
    """
    if least_repeats < 3 or least_length < 1:
        raise ValueError("a run repeats its period three times at least")
    importable(docs.sparkSession)
    schema = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    return rows.mapInArrow(_found(least_length, least_repeats), schema)
