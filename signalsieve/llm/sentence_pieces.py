"""SentencePiece encoding and decoding by a table of distinct marked words.

Pieces of a vocabulary as :class:`signalsieve.llm.piece_bpe.PieceBpe` takes them never cross a
white-space marker, so a marked word is segmented alike wherever it stands. Documents are written
once as numbers of words, by blocks that each list their distinct words. A shuffle brings the lists of
all blocks together by a checksum of the words; there the table of distinct words is made, each word
segmented once, and its ids go back to the blocks, where they are joined by position. However often
a word occurs, it is shuffled once per block, and words travel packed by block and bucket, so no word
and no bucket is hotter than others.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsieve.llm.common import importable, written
from signalsieve.llm.frames import text_slices
from signalsieve.llm.piece_bpe import PieceBpe, piece_model

#: A block closes with so many distinct words, or characters of texts.
BLOCK_WORDS = 1_000_000
BLOCK_CHARACTERS = 64_000_000
#: Buckets of words for each shuffle partition.
BUCKETS = 4
#: Words of a bucket's table; one with more starts the table anew and segments some words again.
TABLE_WORDS = 2_000_000
#: Level of compression of what is stored and sent.
LEVEL = 9
#: Numbers below these bounds take one and two bytes.
ONE_BYTE = 192
TWO_BYTES = ONE_BYTE + (255 - ONE_BYTE) * 256
#: Words of a document joined at once.
JOINED_TOGETHER = 1 << 18

_SPOOL = "block bigint, bucket int, doc_ids array<bigint>, counts array<bigint>, single bigint, numbers binary, lengths binary, words binary"
_TABLE = "block bigint, bucket int, lengths binary, ids binary"
_JOINED = "doc_id bigint, ids array<int>, decoded string"
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def _row(schema: str, **values) -> pa.RecordBatch:
    """A batch of one row of this schema; columns not given are null."""
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], _KINDS[k]) for n, k in fields], names=[n for n, _ in fields])


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(data)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 to the 32nd, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return _pack(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def short(numbers: np.ndarray) -> bytes:
    """Numbers of which most are small, compressed: a byte each, then the second bytes of those that need
    one, then all four of the few largest."""
    two = (numbers >= ONE_BYTE) & (numbers < TWO_BYTES)
    three = numbers >= TWO_BYTES
    first = np.where(two, ONE_BYTE + (numbers - ONE_BYTE >> 8), np.where(three, 255, numbers))
    rest = (numbers[three] - TWO_BYTES).astype("<u4").view(np.uint8).reshape(-1, 4)
    return _pack(b"".join([first.astype(np.uint8).tobytes(), (numbers[two] - ONE_BYTE & 255).astype(np.uint8).tobytes(), rest.T.tobytes()]))


def long(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of :func:`short`."""
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).astype(np.int64)
    numbers, rest = flat[:n].copy(), flat[n:]
    two, three = (numbers >= ONE_BYTE) & (numbers < 255), numbers == 255
    k = int(np.count_nonzero(two))
    numbers[two] = ONE_BYTE + (numbers[two] - ONE_BYTE << 8) + rest[:k]
    numbers[three] = TWO_BYTES + (rest[k:].reshape(4, -1) << np.array([[0], [8], [16], [24]])).sum(axis=0)
    return numbers


def gather(flat: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The parts ``chosen`` of ``flat`` one after the other; part i lies from starts[i] to starts[i + 1]."""
    begins = starts[chosen]
    sizes = starts[chosen + 1] - begins
    ends = np.cumsum(sizes)
    return flat[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class _Block:
    """Documents of a block as numbers of words; when it closes, frequent words get small numbers."""

    def __init__(self):
        self.numbers: dict[str, int] = defaultdict(count().__next__)
        self.documents: list[tuple[list, list[int], np.ndarray]] = []
        self.characters = 0

    def add(self, ids: list, texts: list[list[str]]) -> None:
        counts = [len(t) for t in texts]
        flat = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(texts)), "<u4", sum(counts))
        self.documents.append((ids, counts, flat))
        self.characters += sum(map(len, chain.from_iterable(texts)))

    def rows(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """The words by bucket, their numbers by bucket, and the documents."""
        words = list(self.numbers)
        total = np.zeros(len(words), np.int64)
        for _, _, flat in self.documents:
            total += np.bincount(flat, minlength=len(words))
        ranked = np.argsort(-total, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[ranked] = np.arange(len(words))
        data = [words[i].encode() for i in ranked.tolist()]
        dealt = np.fromiter(map(zlib.crc32, data), np.int64, len(data)) % buckets
        order = np.argsort(dealt, kind="stable")
        cuts = np.searchsorted(dealt[order], np.arange(buckets + 1))
        for bucket in np.flatnonzero(np.diff(cuts)).tolist():
            chosen = order[cuts[bucket] : cuts[bucket + 1]]
            parts = [data[i] for i in chosen.tolist()]
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            yield _row(_SPOOL, block=block, bucket=bucket, lengths=packed(lengths), words=_pack(b"".join(parts)))
            yield _row(_SPOOL, block=block, bucket=bucket, numbers=packed(np.diff(chosen, prepend=0)))
        # Words found once come last, in the order in which they are met, so that a row needs the first of its own only.
        often = int(np.count_nonzero(total > 1))
        for ids, counts, flat in self.documents:
            chosen = rank[flat]
            once = chosen >= often
            first = int(chosen[once][0]) if once.any() else 0
            yield _row(_SPOOL, block=block, doc_ids=ids, counts=counts, single=first, numbers=short(np.where(once, 0, chosen + 1)))


def _numbered(model, buckets: int, block_words: int, block_characters: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number, block = piece_model(model.value).words, TaskContext.get().partitionId() << 32, _Block()
        for rows in text_slices(batches):
            block.add(rows.column("doc_id").to_pylist(), [split(t) for t in rows.column("text").to_pylist()])
            if len(block.numbers) >= block_words or block.characters >= block_characters:
                yield from block.rows(number, buckets)
                number, block = number + 1, _Block()
        yield from block.rows(number, buckets)

    return run


def _segmented(model, kind: str, table_words: int) -> Callable:
    """Ids of every listed word, by a table of the distinct words of each bucket; rows come by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, unpack = piece_model(model.value).encode_word, zstandard.ZstdDecompressor().decompress
        bucket, table = None, {}
        for row in chain.from_iterable(b.to_pylist() for b in batches):
            if row["bucket"] != bucket or len(table) > table_words:
                bucket, table = row["bucket"], {}
            data, ends = unpack(row["words"]), np.cumsum(unpacked(row["lengths"])).tolist()
            parts = [data[a:b] for a, b in zip([0, *ends], ends)]
            for part in parts:
                if part not in table:
                    table[part] = np.array(encode(part.decode()), kind).tobytes()
            ids = list(map(table.__getitem__, parts))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(kind).itemsize
            yield _row(_TABLE, block=row["block"], bucket=bucket, lengths=packed(sizes), ids=_pack(b"".join(ids)))

    return run


class _Words:
    """Ids and decoded bytes of all words of a block, by their numbers."""

    def __init__(self, model: PieceBpe, kind: str, rows: list[dict], numbered: dict[int, bytes]):
        unpack = zstandard.ZstdDecompressor().decompress
        none = np.zeros(0, np.int64)
        numbers = np.concatenate([none, *(np.cumsum(unpacked(numbered[r["bucket"]])) for r in rows)])
        sizes = np.concatenate([none, *(unpacked(r["lengths"]) for r in rows)])
        flat = np.frombuffer(b"".join([unpack(r["ids"]) for r in rows]), kind)
        listed, order = np.concatenate([[0], np.cumsum(sizes)]), np.argsort(numbers)
        self.ids = gather(flat, listed, order)
        self.id_starts = np.concatenate([[0], np.cumsum(sizes[order])])
        pieces, piece_starts = model.piece_bytes()
        self.data = gather(pieces, piece_starts, self.ids.astype(np.int64))
        widths = np.concatenate([[0], np.cumsum(np.diff(piece_starts)[self.ids])])
        self.data_starts = widths[self.id_starts]

    def batches(self, row: dict) -> pa.RecordBatch:
        """The documents of a row by the numbers of their words."""
        borders = np.concatenate([[0], np.cumsum(np.array(row["counts"], np.int64))])
        numbers = long(row["numbers"], int(borders[-1])) - 1
        once = numbers < 0
        numbers[once] = row["single"] + np.arange(np.count_nonzero(once))
        steps = [numbers[i : i + JOINED_TOGETHER] for i in range(0, len(numbers), JOINED_TOGETHER)]
        ids = np.concatenate([np.zeros(0, np.int32), *(gather(self.ids, self.id_starts, s).astype(np.int32) for s in steps)])
        data = b"".join([gather(self.data, self.data_starts, s).tobytes() for s in steps])
        at_id, at_byte = (np.concatenate([[0], np.cumsum(np.diff(s)[numbers])])[borders] for s in (self.id_starts, self.data_starts))
        cuts = at_byte.tolist()
        # The marker put before a text is no part of it.
        texts = [data[a + 1 : b].decode() for a, b in zip(cuts, cuts[1:])]
        lists = pa.ListArray.from_arrays(pa.array(at_id, pa.int32()), pa.array(ids))
        return pa.RecordBatch.from_arrays(
            [pa.array(row["doc_ids"], pa.int64()), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"]
        )


def _joined(model, kind: str) -> Callable:
    """Documents of each block, after the block's words, with ids and decoded texts by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, numbered, words = None, [], {}, None
        for row in chain.from_iterable(b.to_pylist() for b in batches):
            if row["block"] != block:
                block, rows, numbered, words = row["block"], [], {}, None
            if row["ids"] is not None:
                rows.append(row)
            elif row["bucket"] is not None:
                numbered[row["bucket"]] = row["numbers"]
            else:
                words = words or _Words(piece_model(model.value), kind, rows, numbered)
                yield words.batches(row)

    return run


def encode_pieces(
    docs: DataFrame,
    model: bytes,
    block_words: int = BLOCK_WORDS,
    block_characters: int = BLOCK_CHARACTERS,
    table_words: int = TABLE_WORDS,
) -> DataFrame:
    """Ids of each text of ``docs`` (doc_id, text) and the text decoded from them: doc_id, ids, decoded.

    ``model`` holds the bytes of a model file, which is sent to the workers. A null or empty text has no ids
    and decodes to the empty string. Rows are handled by themselves: repeated rows and equal texts
    give a row each, a null doc_id stays null, a table without rows gives none. Texts of any length
    are read whole; only doc_id and text are read, so columns of any other names do no harm.
    A task holds one block's words (``block_words`` of them, or ``block_characters`` of texts, before the slice
    that closes it) or one bucket's table (``table_words``) at a time.
    """
    spark = docs.sparkSession
    importable(spark)
    kind = "<u2" if piece_model(model).size <= 65536 else "<u4"
    sent = spark.sparkContext.broadcast(model)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbered = _numbered(sent, BUCKETS * partitions, block_words, block_characters)
    spool = written(rows.mapInArrow(numbered, _SPOOL), "words")
    lists = spool.filter("words is not null").select("bucket", "block", "lengths", "words")
    table = lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_segmented(sent, kind, table_words), _TABLE)
    documents = spool.filter("words is null").select("block", "bucket", "doc_ids", "counts", "single", "numbers")
    both = table.unionByName(documents, allowMissingColumns=True).withColumn("_last", F.col("doc_ids").isNotNull())
    # A block's words first, then its documents.
    in_order = both.repartition("block").sortWithinPartitions("block", "_last")
    return in_order.mapInArrow(_joined(sent, kind), _JOINED)
