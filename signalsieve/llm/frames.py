"""Texts as independent zstandard frames with cumulative unit counts, so that any unit is found by
decompressing one frame.

A unit is a word with the white space before it; white space at a text's end is a unit of its own.
A frame closes after ``frame_units`` units, so its bounds are known without looking inside: ``units[k]`` and
``chars[k]`` are the units and code points before frame k, and each list ends with the text's total.
Frames put one after the other are a valid zstandard stream of the whole text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsieve.llm.common import importable, written

#: Units per frame: long texts have many frames, most texts one.
FRAME_UNITS = 1024
LEVEL = 1
#: Texts handled together: so many, or fewer once they have so many bytes.
SLICE = 256
SLICE_BYTES = 1 << 22

FRAMED = "doc_id bigint, frames array<binary>, units array<bigint>, chars array<bigint>, marked boolean"

_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one text after the other, and where each begins and ends."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of few rows and, unless one text alone has more, of bounded bytes of texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (i - start == SLICE or held + size > SLICE_BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if sizes:
            yield batch.slice(start)


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Places at which a unit ends and the next begins, in one or many texts' bytes."""
    white = _WHITE[data]
    return np.flatnonzero(~white[:-1] & white[1:]) + 1


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class Cut(NamedTuple):
    """A place in a framed text: in ``frame`` after ``inside`` of its bytes ``data``.

    At the border of two frames ``inside`` is 0 and the frame is not decompressed.
    """

    frame: int
    inside: int
    data: bytes
    chars: int


class Frames(NamedTuple):
    """One framed text."""

    frames: list[bytes]
    units: list[int]
    chars: list[int]

    def cut(self, unit: int) -> Cut:
        """The place before ``unit`` (the text's end for its number of units)."""
        k = bisect_right(self.units, unit) - 1
        before = self.units[k]
        if unit == before:
            return Cut(k, 0, b"", self.chars[k])
        data = zstandard.ZstdDecompressor().decompress(self.frames[k])
        inside = int(unit_ends(np.frombuffer(data, np.uint8))[unit - before - 1])
        return Cut(k, inside, data, self.chars[k] + code_points(np.frombuffer(data[:inside], np.uint8)))

    def between(self, start: Cut, stop: Cut, compress: Callable[[bytes], bytes]) -> list[bytes]:
        """Frames of the text from ``start`` to ``stop``: whole ones as they are, cut ones anew."""
        if start.inside and start.frame == stop.frame:
            part = start.data[start.inside : stop.inside]
            return [compress(part)] if part else []
        out, first = [], start.frame
        if start.inside:
            out, first = [compress(start.data[start.inside :])], start.frame + 1
        out += self.frames[first : stop.frame]
        return [*out, compress(stop.data[: stop.inside])] if stop.inside else out


def compressor() -> Callable[[bytes], bytes]:
    return zstandard.ZstdCompressor(level=LEVEL).compress


def stream(frames: list[bytes]) -> Iterator[bytes]:
    """The text of ``frames`` in order, one frame at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(f) for f in frames)


def _framed(markers: tuple[bytes, ...], frame_units: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = compressor()
        for rows in text_slices(batches):
            data, at = flat_bytes(rows.column("text"))
            ends = unit_ends(data)
            # The first end inside each text, and the first at or after its own end.
            firsts, lasts = np.searchsorted(ends, at[:-1], "right"), np.searchsorted(ends, at[1:], "left")
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            columns: list[list] = [[], [], [], []]
            for a, b, first, last in zip(at[:-1].tolist(), at[1:].tolist(), firsts.tolist(), lasts.tolist()):
                n = last - first + 1 if b > a else 0
                borders = np.array([a, *ends[first:last][frame_units - 1 :: frame_units], b]) if n else np.array([a])
                text = data[a:b].tobytes()
                cuts = (borders - a).tolist()
                columns[0].append([compress(text[x:y]) for x, y in zip(cuts, cuts[1:])])
                columns[1].append([*range(0, n, frame_units), n])
                columns[2].append((points[borders] - points[a]).tolist())
                columns[3].append(any(m in text for m in markers))
            kinds = [pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "frames", "units", "chars", "marked"],
            )

    return run


def write_frames(docs: DataFrame, markers: tuple[str, ...] = (), frame_units: int = FRAME_UNITS) -> DataFrame:
    """Framed texts of ``docs`` (doc_id, text) as a table in the shared folder: doc_id, frames, units,
    chars, and whether the text holds one of ``markers``.

    A null or empty text has no frames and no units. Repeated rows are framed each; a table without rows
    gives none. A text of any length is cut into frames of ``frame_units`` units; other columns,
    whatever their names, are not read.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(_framed(tuple(m.encode() for m in markers), frame_units), FRAMED), "frames")
