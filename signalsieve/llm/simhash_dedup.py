"""SimHash near-duplicates, found by vantage-point trees.

Each text gets a 64-bit fingerprint. Distances to vantage points are Hamming distances over blocks of
bits: level i of the top tree measures block i of a fingerprint against block i of the vantage point.
Each is a lower bound of the whole distance by the triangle inequality, and as the blocks are
disjoint their differences add up: two fingerprints within distance r lie in cells whose distance
vectors differ by r in sum at most. So a fingerprint lives in one cell, its shard, and also visits
the few cells that its ball of radius r overlaps. Within a shard a further tree over whole distances
prunes until small sets are compared exactly. A shard passes on a spanning forest, never pairs.

Cells with more fingerprints than fit one task are split again by a tree with more levels; with one
level per bit, a cell holds a single fingerprint. Nothing is dropped at any depth.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.llm.common import LOCATOR, importable, located, written
from signalsieve.llm.components import components

SHINGLE = 3
RADIUS = 2
#: Most fingerprints that one task compares.
CELL_ROWS = 200_000
#: Levels of the top tree, coarse to fine; all divide 64.
LEVELS = (4, 8, 16, 64)
#: Fingerprints of the vantage points: fixed bit patterns, the blocks of which differ.
VANTAGE = 0x9E3779B97F4A7C15
LEAF = 1 << 21


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """Bit k is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        flat, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([simhash(t or "") for t in batch.column("text").to_pylist()], dtype=np.uint64)
        kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        names = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(prints.view(np.int64))], names=[*names, "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``print``: the fingerprint's bits as a long."""
    importable(docs.sparkSession)
    kept = docs.drop("text")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes), "print bigint"])
    return docs.mapInArrow(_fingerprint_batches, schema)


def _long(value: int) -> Column:
    value &= 2**64 - 1
    return F.lit(value - 2**64 if value >= 2**63 else value).cast("long")


def _digit(levels: int) -> int:
    """Bits that hold one level's distance in a cell number."""
    return (64 // levels).bit_length()


def cell_of(levels: int) -> Column:
    """The vector of distances to the vantage point's blocks, as one number."""
    width = 64 // levels
    mask = (1 << width) - 1
    total = F.lit(0).cast("long")
    for i in range(levels):
        block = F.shiftrightunsigned("print", i * width).bitwiseXOR(_long(VANTAGE >> (i * width))).bitwiseAND(_long(mask))
        total = total + F.shiftleft(F.bit_count(block).cast("long"), i * _digit(levels))
    return total


def ball_steps(levels: int, radius: int = RADIUS) -> list[int]:
    """What to add to a cell's number for the cells whose vectors differ by ``radius`` in sum at most.

    Half of them: the other half are the same steps taken back.
    """
    steps = set()
    for changed in range(1, min(radius, levels) + 1):
        for places in combinations(range(levels), changed):
            for by in product([s for s in range(-radius, radius + 1) if s], repeat=changed):
                if sum(map(abs, by)) <= radius:
                    steps.add(sum(s << (p * _digit(levels)) for p, s in zip(places, by)))
    return sorted(s for s in steps if s > 0)


def _near(prints: np.ndarray, others: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with prints[i] and others[j] within ``radius``: a vantage-point tree over both.

    The vantage point is one of ``prints``; those nearer than the median go one way, the rest the
    other, and ``others`` follow wherever the triangle inequality does not rule them out.
    """
    stack = [(np.arange(len(prints)), np.arange(len(others)))]
    while stack:
        i, j = stack.pop()
        if not len(i) or not len(j):
            continue
        if len(i) * len(j) > LEAF:
            vantage = prints[i[len(i) // 2]]
            own, far = np.bitwise_count(prints[i] ^ vantage), np.bitwise_count(others[j] ^ vantage).astype(int)
            middle = int(np.median(own))
            inner = own <= middle
            if inner.all():
                middle -= 1
                inner = own <= middle
            if inner.any() and not inner.all():
                stack.append((i[inner], j[far <= middle + radius]))
                stack.append((i[~inner], j[far >= middle + 1 - radius]))
                continue
        step = max(1, LEAF // len(i))
        for start in range(0, len(j), step):
            some = j[start : start + step]
            a, b = np.nonzero(np.bitwise_count(prints[i][:, None] ^ others[some][None, :]) <= radius)
            yield i[a], some[b]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[k] and b[k]; ``parent`` stays flat, the least member is the root."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


class _Cell:
    """One shard: its fingerprints are held, visitors pass by in batches."""

    def __init__(self, radius: int):
        self.radius, self.parts, self.parent = radius, [], None

    def live(self, prints: np.ndarray, nodes: np.ndarray) -> None:
        self.parts.append((prints, nodes))

    def _settle(self) -> None:
        self.prints, self.nodes = (np.concatenate(x) for x in zip(*self.parts))
        self.parent = np.arange(len(self.prints))
        if len(self.prints) > 1:
            for a, b in _near(self.prints, self.prints, self.radius):
                _unite(self.parent, a[a < b], b[a < b])

    def visit(self, prints: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges from visitors to the shard."""
        if not self.parts:
            return nodes[:0], nodes[:0]
        if self.parent is None:
            self._settle()
        n = len(self.prints)
        parent = np.concatenate([self.parent, n + np.arange(len(prints))])
        for a, b in _near(self.prints, prints, self.radius):
            _unite(parent, a, n + b)
        self.parent = parent[:n]
        linked = np.flatnonzero(parent[n:] < n)
        return nodes[linked], self.nodes[parent[n + linked]]

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges within the shard."""
        if not self.parts:
            none = np.zeros(0, np.int64)
            return none, none
        if self.parent is None:
            self._settle()
        linked = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return self.nodes[linked], self.nodes[self.parent[linked]]


def _shard_batches(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Forest edges of the shards of a task; rows come sorted by cell, residents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cell = None, _Cell(radius)
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, prints, nodes, lives = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "print", "node", "lives"))
            prints = prints.view(np.uint64)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (lives[1:] != lives[:-1])) + 1
            edges = []
            for a, b in zip([0, *cuts], [*cuts, len(cells)]):
                if cells[a] != current:
                    edges.append(cell.close())
                    current, cell = cells[a], _Cell(radius)
                if lives[a]:
                    cell.live(prints[a:b], nodes[a:b])
                else:
                    edges.append(cell.visit(prints[a:b], nodes[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*edges)], names=["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cell.close()], names=["a", "b"])

    return run


def forest(prints: DataFrame, radius: int = RADIUS, cell_rows: int = CELL_ROWS, levels: int | None = None) -> DataFrame:
    """Edges (a, b) between nodes that connect all fingerprints within ``radius`` of each other.

    ``prints`` holds distinct fingerprints: print, node (both long). The tree has more levels for
    more fingerprints, which changes how much is compared and never what is found.
    """
    importable(prints.sparkSession)
    if levels is None:
        many = prints.count()
        levels = next(x for x, most in zip(LEVELS, (2**24, 2**31, 2**63)) if many < most)
    edges, pending = [], prints
    for depth in [x for x in LEVELS if x >= levels]:
        celled = pending.withColumn("cell", cell_of(depth))
        crowded = written(celled.groupBy("cell").count().filter(F.col("count") > cell_rows).select("cell"), "crowded")
        split = not crowded.isEmpty()
        half = [_long(s) for s in ball_steps(depth, radius)]
        residents = celled.join(crowded, "cell", "left_anti") if split else celled
        visits = residents.withColumn("step", F.explode(F.array(*half)))
        if split:
            pending = written(celled.join(crowded, "cell", "left_semi"), "pending")
            both = [*half, *(-s for s in half)]
            visits = visits.unionByName(pending.withColumn("step", F.explode(F.array(*both))))
        visits = visits.withColumn("cell", F.col("cell") + F.col("step")).drop("step")
        if split:
            visits = visits.join(crowded, "cell", "left_anti")
        rows = residents.withColumn("lives", F.lit(True)).unionByName(visits.withColumn("lives", F.lit(False)))
        dealt = rows.repartition("cell").sortWithinPartitions("cell", F.col("lives").desc())
        edges.append(dealt.mapInArrow(_shard_batches(radius), "a bigint, b bigint"))
        if not split:
            break
        pending = pending.drop("cell")
    found = edges[0]
    for more in edges[1:]:
        found = found.unionByName(more)
    return found


def near_duplicates(docs: DataFrame, radius: int = RADIUS, **options) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``print`` and ``component_id``.

    Needs doc_id (long) and text. Fingerprints within ``radius`` bits are linked, directly or
    through others, and component_id is the smallest doc_id reachable. A null, empty or blank text
    has fingerprint zero and is linked like any other. Rows with equal fingerprints are one point.
    Rows without doc_id take their component from others with that fingerprint, or have none.
    Columns named print or component_id are replaced. An empty table gives an empty result.
    """
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ("print", "component_id")))
    prints = written(fingerprints(docs), "prints")
    points = written(
        prints.filter(F.col("doc_id").isNotNull()).groupBy("print").agg(F.min("doc_id").cast("long").alias("node")), "points"
    )
    groups = components(forest(points, radius, **options))
    classes = written(
        points.join(groups, "node", "left").select("print", F.coalesce("component", "node").alias("component_id")), "classes"
    )
    return prints.join(classes, "print", "left").select(*(c for c in prints.columns if c != "print"), "print", "component_id")


def hex_print() -> Column:
    return F.lpad(F.lower(F.hex("print")), 16, "0")


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id, in its own columns."""
    placed, narrow, names = located(docs, "doc_id", "text")
    rows = written(near_duplicates(narrow, **options).drop("print"), "near")
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("_no"), "doc_id", *LOCATOR)).alias("_first"))
    here = F.col("_file").eqNullSafe(F.col("_first._file")) & F.col("_row").eqNullSafe(F.col("_first._row"))
    dropped = rows.filter(F.col("component_id").isNotNull()).join(first, "component_id").filter(~here)
    return placed.join(dropped.select(*LOCATOR).toDF(*names), names, "left_anti").select(*docs.columns)
