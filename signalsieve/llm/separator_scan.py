"""Token counts of documents in flat token files, found by a scan for end-of-document ids.

A flat file is nothing but ids, one document after the other, each closed by the end id; it has no
index. It is read in blocks that begin and end anywhere. Each block is searched at once for end ids;
a prefix scan over block summaries (tokens, ends, place of the last end) then says where each
block starts, how many documents are closed before it and where the open one began, which
stitches the documents that lie across blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalsieve.llm.common import LOCATOR, importable, new_folder, with_locator
from signalsieve.llm.token_ids import library_ids

#: Tokens per block of a flat file.
BLOCK_TOKENS = 1 << 20
SLICE = 512

FLAT = "file string, part bigint, block int, tokens binary"
_SCANNED = "file string, part bigint, block int, n_tokens bigint, ends array<bigint>"


def _flatten(spec, end: int, block_tokens: int) -> Callable:
    """Blocks of each file's texts in the order of its rows. A task may read a piece of a file, or
    several files; ``part`` is the piece's first row, so parts and blocks are in the file's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = library_ids(spec.value, special_as_text=True)
        stop = np.array([end], model.kind).tobytes()
        size = block_tokens * model.kind.itemsize
        file, part, block, held = None, 0, 0, bytearray()

        def row(data: bytes) -> pa.RecordBatch:
            values = zip([file, part, block, data], [pa.string(), pa.int64(), pa.int32(), pa.binary()])
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in values], names=["file", "part", "block", "tokens"])

        expected = -1
        slices = (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE))
        for rows in slices:
            ids = model.ids(rows.column("text").to_pylist())
            for at, place, doc in zip(*(rows.column(c).to_pylist() for c in LOCATOR), ids):
                if at != file or place != expected:
                    if held:
                        yield row(bytes(held))
                    file, part, block, held = at, place, 0, bytearray()
                expected = place + 1
                held += doc + stop
                while len(held) >= size:
                    yield row(bytes(held[:size]))
                    del held[:size]
                    block += 1
        if held:
            yield row(bytes(held))

    return run


def write_flat_files(docs: DataFrame, spec: str, end: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files of ``docs`` (text with locators), in the order of its files and rows."""
    spark = docs.sparkSession
    importable(spark)
    path = new_folder(spark, "flat")
    flatten = _flatten(spark.sparkContext.broadcast(spec), end, block_tokens)
    docs.select("text", *LOCATOR).mapInArrow(flatten, FLAT).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(FLAT).parquet(path)


def _scan(end: int, kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(t, kind) for t in batch.column("tokens").to_pylist()]
            ends = [np.flatnonzero(t == end) for t in tokens]
            cuts = np.cumsum([0, *map(len, ends)])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([*ends, np.zeros(0, np.int64)]), pa.int64()))
            sizes = pa.array([len(t) for t in tokens], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("file", "part", "block")), sizes, lists], names=["file", "part", "block", "n_tokens", "ends"]
            )

    return run


def _before(value: Column, window: Window, fold: Callable = F.sum, start: int = 0) -> Column:
    return F.coalesce(fold(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(start).cast("long"))


def scan_flat_files(flat: DataFrame, end: int, kind: str = "<u2") -> DataFrame:
    """Documents closed by ``end`` in flat files: file, ordinal (from 0 in its file), start (tokens
    of the file before it), n_tokens (with the end id).

    ``flat`` has blocks of ids in the order (file, part, block), as little-endian numbers of
    ``kind``. Blocks may begin and end anywhere, also in the middle of a document. Tokens after a file's
    last end id are no document. No rows give no documents.

    The prefix scan has two levels: over the blocks of a part, then over the parts of a file,
    each far fewer than the tokens.
    """
    importable(flat.sparkSession)
    blocks = flat.mapInArrow(_scan(end, kind), _SCANNED)
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    inside = Window.partitionBy("file", "part").orderBy("block")
    blocks = blocks.withColumns(
        {
            "_tokens": _before(F.col("n_tokens"), inside),
            "_ends": _before(F.size("ends").cast("long"), inside),
        }
    ).withColumn("_last", F.max(F.col("_tokens") + last).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    parts = blocks.groupBy("file", "part").agg(
        F.sum("n_tokens").alias("p_tokens"), F.sum(F.size("ends")).alias("p_ends"), F.max(F.col("_tokens") + last).alias("p_last")
    )
    across = Window.partitionBy("file").orderBy("part")
    parts = parts.withColumns({"b_tokens": _before(F.col("p_tokens"), across), "b_ends": _before(F.col("p_ends"), across)})
    parts = parts.withColumn("b_last", _before(F.col("b_tokens") + F.col("p_last"), across, F.max, -1))
    joined = blocks.join(parts.select("file", "part", "b_tokens", "b_ends", "b_last"), ["file", "part"])
    base = F.col("b_tokens") + F.col("_tokens")
    previous = F.coalesce(F.col("b_tokens") + F.col("_last"), F.col("b_last"))
    rows = joined.select(
        "file",
        (F.col("b_ends") + F.col("_ends")).alias("_first"),
        previous.alias("_previous"),
        F.transform("ends", lambda x: base + x).alias("_at"),
    )
    ends = rows.select("file", "_first", "_previous", "_at", F.posexplode("_at").alias("_k", "_end"))
    begins = F.coalesce(F.get("_at", F.col("_k") - 1), F.col("_previous")) + 1
    return ends.select(
        "file", (F.col("_first") + F.col("_k")).alias("ordinal"), begins.alias("start"), (F.col("_end") + 1 - begins).alias("n_tokens")
    )


def token_counts(docs: DataFrame, spec: str, end: int) -> DataFrame:
    """Token counts of ``docs`` (doc_id, text), by way of flat files: doc_id, start, n_tokens.

    Texts are encoded as a whole, special tokens' strings as ordinary text, and closed by ``end``,
    which n_tokens includes; a null text is empty. start counts within the flat file, which
    has the rows of one file of ``docs`` in its order. Other columns are not read.

    Rows are told apart by their place in their file, so repeated rows, equal ids and null ids have a
    result each. A table without rows gives none; a text of any length spans as many blocks as it needs.
    """
    placed = with_locator(docs.select("doc_id", "text"))
    kind = library_ids(spec).kind.str
    counts = scan_flat_files(write_flat_files(placed, spec, end), end, kind)
    found = counts.withColumnRenamed("file", "_file").withColumnRenamed("ordinal", "_row")
    return placed.select("doc_id", *LOCATOR).join(found, LOCATOR).select("doc_id", "start", "n_tokens")
