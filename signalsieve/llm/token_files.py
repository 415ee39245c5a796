"""Token files: ids of documents, Huffman-coded from global counts, in independent blocks.

A file set is a folder with two Parquet tables, so that any store Spark reaches can hold it.
``codebook`` has one row: the code length of every id. ``blocks`` has one row per block, in
ascending doc_id by shard and block: the documents' ids and token counts, the tokens in the shard
before the block, the codes, each document starting at a byte, and the bit offset of every 256th
token. A block needs nothing but the codebook to be decoded, from any checkpoint on, by table look-up.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalsieve.llm.common import importable, new_folder
from signalsieve.llm.huffman import STRIDE, Codebook, code_lengths
from signalsieve.llm.token_ids import each, library_ids

#: Documents coded and written together, and bytes of codes per block.
SLICE = 512
#: Fewer, so that the arrays of a step stay in the processor's cache.
CODED_TOGETHER = 96
BLOCK_BYTES = 1 << 20

_IDS = "doc_id bigint, ids binary"
_COUNTS = "id int, n bigint"
_CODED = "shard int, doc_id bigint, n_tokens bigint, codes binary, checkpoints binary"
_BLOCKS = (
    "shard int, block int, tokens_before bigint, doc_ids array<bigint>, n_tokens array<bigint>, "
    "starts binary, codes binary, checkpoints binary"
)


def _to_ids(spec, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = library_ids(spec.value)
        stop = np.array([end], model.kind).tobytes()

        def use(rows: pa.RecordBatch) -> pa.RecordBatch:
            ids = [i + stop for i in model.ids(rows.column("text").to_pylist())]
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

        return each(batches, SLICE, use)

    return run


def _count(kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                ids = np.frombuffer(b"".join(batch.column("ids").slice(start, SLICE).to_pylist()), kind)
                counts = np.bincount(ids, minlength=len(total))
                counts[: len(total)] += total
                total = counts
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return run


def _code(kind: str, lengths) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(np.frombuffer(lengths.value, np.uint8))

        def use(rows: pa.RecordBatch) -> pa.RecordBatch:
            parts = rows.column("ids").to_pylist()
            counts = np.array([len(p) for p in parts]) // np.dtype(kind).itemsize
            codes, checkpoints = book.encode(np.frombuffer(b"".join(parts), kind).astype(np.int64), counts)
            cuts = np.cumsum(-(-counts // STRIDE))[:-1]
            marks = [c.astype("<u4").tobytes() for c in np.split(checkpoints, cuts)]
            return pa.RecordBatch.from_arrays(
                [
                    rows.column("shard"), rows.column("doc_id"), pa.array(counts, pa.int64()),
                    pa.array(codes, pa.binary()), pa.array(marks, pa.binary()),
                ],
                names=["shard", "doc_id", "n_tokens", "codes", "checkpoints"],
            )

        return each(batches, CODED_TOGETHER, use)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive documents of a shard; rows come sorted by shard and id."""
    shard, block, before = -1, 0, 0
    ids: list = []
    counts: list[int] = []
    codes: list[bytes] = []
    marks: list[bytes] = []

    def row() -> pa.RecordBatch:
        starts = np.cumsum([0, *(len(c) for c in codes)])[:-1].astype("<u8").tobytes()
        values = [shard, block, before, ids, counts, starts, b"".join(codes), b"".join(marks)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 3]
        names = [c.split()[0] for c in _BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    held = 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "codes", "checkpoints"))
        for place, doc, n, code, mark in zip(*columns):
            if place != shard:
                if ids:
                    yield row()
                shard, block, before, held = place, 0, 0, 0
                ids, counts, codes, marks = [], [], [], []
            ids.append(doc), counts.append(n), codes.append(code), marks.append(mark)
            held += len(code) + 8
            if held >= BLOCK_BYTES:
                yield row()
                block, before, held = block + 1, before + sum(counts), 0
                ids, counts, codes, marks = [], [], [], []
    if ids:
        yield row()


def write_token_files(docs: DataFrame, spec: str, end: int = 2, path: str | None = None) -> str:
    """Writes the token files of ``docs`` (doc_id, text) and returns their folder.

    ``spec`` is the text of a ``tokenizers`` file; ``end`` follows each document's ids. A null text is
    empty. Documents lie in ascending doc_id, null first; rows with one id lie together. Other
    columns are not read. An empty table gives files without blocks.
    """
    spark = docs.sparkSession
    importable(spark)
    path = path or new_folder(spark, "tokens")
    kind = library_ids(spec).kind.str
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spool = f"{new_folder(spark, 'ids')}"
    docs.mapInArrow(_to_ids(spark.sparkContext.broadcast(spec), end), _IDS).write.option("compression", "zstd").parquet(spool)
    ids = spark.read.schema(_IDS).parquet(spool)
    # As many rows as there are ids in the vocabulary.
    counts = ids.select("ids").mapInArrow(_count(kind), _COUNTS).groupBy("id").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        table[r["id"]] = r["n"]
    lengths = code_lengths(table).tobytes()
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    # Shards are ranges of doc_id. Their bounds come from the ids alone: a range partitioning of the
    # codes would make them twice, once to look at a sample.
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(ids.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.1 / shards)))
    below = F.filter(F.array(*(F.lit(int(b)) for b in bounds)).cast("array<bigint>"), lambda b: b < F.col("doc_id"))
    placed = ids.withColumn("shard", F.size(below))
    coded = placed.mapInArrow(_code(kind, spark.sparkContext.broadcast(lengths)), _CODED)
    ordered = coded.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id")
    ordered.mapInArrow(_pack, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def _decoded(lengths, use: Callable, schema: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(np.frombuffer(lengths.value, np.uint8))
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["n_tokens"], np.int64)
                marks = -(-counts // STRIDE)
                last = np.cumsum(marks)
                lanes = np.full(int(last[-1]), STRIDE, np.int64)
                lanes[last - 1] = counts - STRIDE * (marks - 1)
                starts = np.frombuffer(row["checkpoints"], "<u4") + np.repeat(np.frombuffer(row["starts"], "<u8").astype(np.int64) * 8, marks)
                ids = book.decode(row["codes"], starts, lanes).astype("<u4")
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(use(row, ids, ends - counts, ends), names=schema)

    return run


def _digest(row: dict, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
    n = len(starts)
    return [
        pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()),
        pa.array(row["tokens_before"] + starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64()),
    ]


def _whole(row: dict, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    lists = pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(ids, pa.int64()))
    n = len(starts)
    return [
        pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()),
        pa.array(row["tokens_before"] + starts, pa.int64()), lists,
    ]


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of the token files at ``path``: doc_id, start, and the list ``ids``; with
    ``digest`` instead n_tokens and ids_crc32, the CRC-32 of the ids as 32-bit numbers."""
    importable(spark)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    lengths = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"]))
    if digest:
        names, use, types = ["doc_id", "shard", "start", "n_tokens", "ids_crc32"], _digest, ["bigint", "int", "bigint", "bigint", "bigint"]
    else:
        names, use, types = ["doc_id", "shard", "start", "ids"], _whole, ["bigint", "int", "bigint", "array<bigint>"]
    docs = blocks.mapInArrow(_decoded(lengths, use, names), ", ".join(f"{n} {t}" for n, t in zip(names, types)))
    # One row per shard; blocks know what lies before them in their own.
    sizes = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("_n"))
    earlier = Window.partitionBy().orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return docs.join(offsets, "shard").withColumn("start", F.col("start") + F.col("_before")).drop("shard", "_before")
