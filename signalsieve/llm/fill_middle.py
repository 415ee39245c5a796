"""Fill-in-middle transformation over seekable compressed frames.

Texts are stored as independent frames (:mod:`signalsieve.llm.frames`). Two cuts, drawn from a hash of
the id, are found by their unit numbers: only the frames they fall into are decompressed and
compressed anew in two parts, all others move as they are. The output is a list of frames too, whose
stream is the transformed text; digests and the way back stream it frame by frame.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from signalsieve.llm.common import importable
from signalsieve.llm.frames import Frames, compressor, stream, write_frames

# --- Fixed values: markers of prefix, suffix and middle, and their order in each form ---

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

# --- End of fixed values ---

TRANSFORMED = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output array<binary>"
_DIGESTED = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
#: Framed texts handled together.
SLICE = 256


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The four numbers drawn for an id; a null id is drawn for as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: Frames, marked: bool, numbers: list[int], rate: int, spm_rate: int, compress: Callable) -> tuple:
    """Form, code points of prefix and middle (none if plain), and the output's frames."""
    n = text.units[-1]
    if n == 0 or marked or numbers[2] % 100 >= rate:
        return "plain", None, None, text.frames
    first, second = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
    start, low, high, stop = text.cut(0), text.cut(first), text.cut(second), text.cut(n)
    parts = {PREFIX: (start, low), MIDDLE: (low, high), SUFFIX: (high, stop)}
    form = "spm" if numbers[3] % 100 < spm_rate else "psm"
    output = []
    for marker in ORDER[form]:
        output += [compress(marker.encode()), *text.between(*parts[marker], compress)]
    return form, low.chars, high.chars - low.chars, output


def restored(output: list[bytes], form: str) -> Iterator[bytes]:
    """The original text, in parts, from a transformed one and its form.

    A first stream finds the markers, wherever frames end; a second one gives the parts in the
    text's order, decompressing only the frames each of them needs.
    """
    if form == "plain":
        yield from stream(output)
        return
    markers = [m.encode() for m in ORDER[form]]
    sizes, places, at, tail = [], [], 0, b""
    for data in stream(output):
        window = tail + data
        base, begin = at - len(tail), 0
        while len(places) < len(markers) and (found := window.find(markers[len(places)], begin)) >= 0:
            places.append(base + found)
            begin = found + len(markers[0])
        at += len(data)
        sizes.append(at)
        tail = window[max(begin, len(window) - len(markers[0]) + 1) :]
    ends = [*places[1:], at]
    spans = {m: (p + len(m.encode()), e) for m, p, e in zip(ORDER[form], places, ends)}
    for marker in (PREFIX, MIDDLE, SUFFIX):
        start, stop = spans[marker]
        before = 0
        for frame, after in zip(output, sizes):
            if before < stop and after > start:
                yield next(stream([frame]))[max(start - before, 0) : stop - before]
            before = after


def _transformed(seed: int, rate: int, spm_rate: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = compressor()
        slices = (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE))
        for rows in slices:
            ids, *columns = (rows.column(c).to_pylist() for c in ("doc_id", "frames", "units", "chars", "marked"))
            out = [
                transform(Frames(f, u, c), m, draws(seed, i), rate, spm_rate, compress) for i, f, u, c, m in zip(ids, *columns)
            ]
            values = [ids, [u[-1] for u in columns[1]], *(zip(*out))]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in TRANSFORMED.split(", ")]
            )

    return run


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, frame_units: int | None = None
) -> DataFrame:
    """Each text of ``docs`` (doc_id, text), of ``rate`` in 100 the middle moved to the end: doc_id, n (units),
    form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output (frames).

    A null or empty text and one that holds a marker stay plain. Draws depend on the id alone: rows with
    one id and text have one result, equal texts under different ids their own; a null id counts as
    an empty one. A table without rows gives none. Texts of any length are framed, so memory is that of
    the compressed text and a frame. Other columns, whatever their names, are not read.
    """
    if not 0 <= rate <= 100 or not 0 <= spm_rate <= 100:
        raise ValueError("rates are per cent")
    options = {} if frame_units is None else {"frame_units": frame_units}
    framed = write_frames(docs, (PREFIX, SUFFIX, MIDDLE), **options)
    return framed.mapInArrow(_transformed(seed, rate, spm_rate), TRANSFORMED)


def _each(batches: Iterator[pa.RecordBatch], names: list[str], make: Callable[[list[bytes], str], list[str]]):
    slices = (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE))
    for rows in slices:
        made = [make(o, f) for o, f in zip(rows.column("output").to_pylist(), rows.column("form").to_pylist())]
        kept = {c: rows.column(c) for c in rows.schema.names if c != "output"}
        new = [pa.array([m[k] for m in made], pa.string()) for k in range(len(names))]
        yield pa.RecordBatch.from_arrays([*kept.values(), *new], names=[*kept, *names])


def _digest(output: list[bytes], form: str) -> list[str]:
    digests = []
    for parts in (stream(output), restored(output, form)):
        digest = hashlib.sha256()
        for part in parts:
            digest.update(part)
        digests.append(digest.hexdigest())
    return digests


def frame_digests(transformed: DataFrame) -> DataFrame:
    """SHA-256 of each output and of the text rebuilt from it and its form, streamed frame by frame."""
    importable(transformed.sparkSession)
    return transformed.mapInArrow(lambda b: _each(b, ["output_sha256", "restored_sha256"], _digest), _DIGESTED)


def output_texts(transformed: DataFrame) -> DataFrame:
    """Transformed texts as strings: the columns of :func:`fill_in_middle` with ``output`` as text."""
    importable(transformed.sparkSession)
    schema = TRANSFORMED.replace("output array<binary>", "output string")
    return transformed.mapInArrow(lambda b: _each(b, ["output"], lambda o, _: [b"".join(stream(o)).decode()]), schema)
