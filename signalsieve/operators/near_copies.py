"""Reworded reposts: signals whose texts share most of their word shingles.

Equal texts are one before anything else. MinHash bands then bring similar texts together, and every pair is
checked by the exact Jaccard similarity of its shingle sets before it counts; links join transitively.

A band value with more than ``block`` texts gives no pairs. Its texts are all checked against one of them,
the leader, which links the true near copies; each text that is not like the leader is then
compared with those of the block that share one of its first shingles in hash order. Two sets of the wanted
similarity always share one of these, so nothing that a full block holds is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.functions.texts import fold_text
from signalsieve.operators.graph import connected
from signalsieve.operators.skew import heavy_first_join, salted_join, stable

WORDS = 5
LEAST = 0.8
#: With 24 bands of 4 values a pair of similarity 0.8 meets with probability 0.999997, one of 0.7 with 0.998.
BANDS = 24
ROWS = 4
#: Most texts of a band value that are compared with each other.
BLOCK = 32
#: Texts whose minima are taken together, and bytes of text that are hashed together: some 40 bytes each are needed for these.
SLICE = 256
SLICE_BYTES = 2**18


def shingles(text: Column | str, words: int = WORDS) -> Column:
    """Hashes of a folded text's runs of ``words`` words, ascending, each once.

    A text with fewer words is one shingle; a blank one has none.
    """
    split = F.split(F.coalesce(fold_text(text), F.lit("")), " ")

    def of(parts: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(parts) - words, F.lit(0)))
        # The words one by one, as joining each run costs more than hashing it. Words that a short text lacks are passed over.
        hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(parts, i + k) for k in range(words))))
        return F.when(parts[0] != "", F.array_sort(F.array_distinct(hashes))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(split), of)[0]


def _hashed_texts(words: int, bands: int, rows: int) -> Callable:
    """Tasks that turn folded texts into a key of the whole text, the hashes of its runs of words, each once, and their minima."""
    minima = _minima(bands, rows)
    random = np.random.default_rng(11)
    of_byte = random.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    of_byte[32] = 0  # the space behind a word adds nothing to it
    base, factor, second = np.uint64(0xD1342543DE82EF93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

    def mixed(values: np.ndarray) -> np.ndarray:
        out = (values ^ values >> np.uint64(31)) * factor
        out = (out ^ out >> np.uint64(29)) * second
        return out ^ out >> np.uint64(32)

    def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sizes = np.diff(np.append(starts, len(data)))
        powers = np.multiply.accumulate(np.full(sizes.max(), base, np.uint64))
        terms = of_byte[data]
        terms *= powers[np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)]
        return mixed(np.add.reduceat(terms, starts))

    def run_hashes(hashes: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
        out = np.full(len(first), count, np.uint64)
        for k in range(count):
            out = out * factor + hashes[first + k]
        return mixed(out)

    def sets_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """One set per text; texts lie between ``offsets``, their words are parted by single spaces."""
        filled = np.flatnonzero(np.diff(offsets))
        found = [np.zeros(0, np.uint64)] * (len(offsets) - 1)
        if not len(filled):
            return found
        begins = offsets[filled]
        starts = np.sort(np.concatenate([begins, np.flatnonzero(data == 32) + 1]))
        hashes = word_hashes(data, starts)
        first = np.searchsorted(starts, begins)
        counts = np.diff(np.append(first, len(starts)))
        short = {m: run_hashes(hashes, first[counts == m], m) for m in range(1, words)}
        runs = run_hashes(hashes, np.arange(max(0, len(starts) - words + 1)), words)
        taken = dict.fromkeys(short, 0)
        for i, at, n in zip(filled.tolist(), first.tolist(), counts.tolist()):
            if n < words:
                found[i] = short[n][taken[n] : taken[n] + 1]
                taken[n] += 1
            else:
                found[i] = np.sort(runs[at : at + n - words + 1])
                found[i] = found[i][np.append(True, found[i][1:] != found[i][:-1])]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy()
            slices = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
            starts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), batch.num_rows]
            for start, end in zip(starts, starts[1:]):
                part = batch.slice(start, end - start)
                raw = [t.as_buffer() if t.is_valid else None for t in part.column("_text")]
                keys = [None if b is None else hashlib.sha256(b).hexdigest() for b in raw]
                data = np.frombuffer(b"".join(b for b in raw if b is not None), np.uint8)
                sets = sets_of(data, np.append(0, np.cumsum(sizes[start:end], dtype=np.int64)))
                ends = np.cumsum([0, *map(len, sets)])
                hashes, filled = np.concatenate([np.zeros(0, np.uint64), *sets]), np.diff(ends) > 0
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64)))
                found = minima(hashes, ends[:-1][filled]).T.reshape(-1) if filled.any() else np.zeros(0, np.int64)
                found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(filled) * bands), pa.int32()), pa.array(found))
                columns = [part.column("_row"), part.column("id"), pa.array(keys, pa.string()), lists, found]
                yield pa.RecordBatch.from_arrays(columns, names=["_row", "id", "_key", "shingles", "minima"])

    return run


def _minima(bands: int, rows: int) -> Callable:
    """Gives a value per band of each of the sets of hashes that begin at ``starts``, none of them empty."""
    random = np.random.default_rng(7)
    seeds = random.integers(0, 2**63, bands * rows, dtype=np.uint64)
    factor, second = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

    def values(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        found = np.zeros((bands, len(starts)), np.uint64)
        for k, seed in enumerate(seeds):
            mixed = (flat ^ seed) * factor
            mixed ^= mixed >> np.uint64(32)
            mixed *= second
            band = k // rows
            found[band] = (found[band] ^ np.minimum.reduceat(mixed, starts)) * factor + np.uint64(k)
        return found.view(np.int64)

    return values


def _banded_sets(bands: int, rows: int) -> Callable:
    minima = _minima(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                lists = part.column("shingles")
                sizes = np.diff(lists.offsets.to_numpy())
                found = minima(lists.flatten().to_numpy().view(np.uint64), np.cumsum(sizes) - sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * bands, pa.int32()), pa.array(found.T.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "minima"])

    return run


def band_values(sets: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, band, value) of MinHash values of non-empty ``sets`` (id, shingles)."""
    kind = dict(sets.dtypes)["id"]
    made = sets.filter("size(shingles) > 0").select("id", "shingles").mapInArrow(
        _banded_sets(bands, rows), f"id {kind}, minima array<bigint>"
    )
    return made.select("id", F.posexplode("minima").alias("band", "value"))


def similar_pairs(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Those of the written ``pairs`` (a, b) whose sets have the Jaccard similarity ``least`` or more."""
    # Written, so that its size is known and few ids are sent to the sets rather than all sets shuffled.
    wanted = stable(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = stable(sets.select("id", "shingles").join(wanted, "id", "left_semi"))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_y"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("_x", "_y"))
    return both.filter(shared >= F.lit(least) * (F.size("_x") + F.size("_y") - shared)).select("a", "b")


def near_links(
    sets: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, values: DataFrame | None = None
) -> DataFrame:
    """Links (a, b) of sets (id, shingles) that are similar and meet in a band; ``values`` are their :func:`band_values` if these are known.

    Not all pairs of a full block are listed, but all that connect it.
    """
    values = stable(band_values(sets, bands, rows) if values is None else values)
    groups = values.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("id").alias("leader")).filter("n > 1")
    members = stable(salted_join(values, groups, ["band", "value"]))
    small, full = members.filter(F.col("n") <= block), members.filter(F.col("n") > block)
    one = small.select("band", "value", F.col("id").alias("a"))
    other = small.select("band", "value", F.col("id").alias("b"))
    pairs = one.join(other, ["band", "value"]).filter("a < b").select("a", "b")
    stars = full.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    links = stable(similar_pairs(stable(pairs.unionByName(stars).distinct()), sets, least))
    # Texts of full blocks that are not like the leader, against all texts there.
    linked = links.select(F.col("a").alias("leader"), F.col("b").alias("id"))
    loose = stable(full.filter("id <> leader").join(linked, ["leader", "id"], "left_anti").select("band", "value", "id"))
    if loose.isEmpty():
        return links
    here = full.join(loose.select("band", "value").distinct(), ["band", "value"], "left_semi").select("id").distinct()
    marked = stable(here.join(loose.select("id", F.lit(True).alias("loose")).distinct(), "id", "left").fillna(False))
    return _loose_links(marked, sets, links, least, block)


def _often_enough(x: str, y: str, least: float) -> Column:
    """Whether two sets may be similar though they share frequent shingles only."""
    return F.least(f"{x}often", f"{y}often") >= F.lit(least / (1 + least)) * (F.col(f"{x}size") + F.col(f"{y}size")) - F.lit(1e-6)


def _like(x: str, y: str, least: float) -> Column:
    """Whether two sets may be similar by their sizes."""
    return F.least(f"{x}size", f"{y}size") >= F.lit(least) * F.greatest(f"{x}size", f"{y}size")


def _first_shingles(here: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """(shingle, hot, id, loose, size, often, last) of the first shingles of the sets ``here``, those in over ``block`` of them last.

    ``often`` is the number of a set's such shingles and ``last`` that of those among its first ones.
    """
    found = sets.select("id", "shingles").join(here, "id")
    tokens = stable(found.select("id", "loose", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle")))
    counted = tokens.groupBy("shingle").agg((F.count("*") > block).alias("hot"))
    parts = tokens.join(counted, "shingle").groupBy("id", "loose", "size").agg(
        F.array_sort(F.collect_list(F.struct("hot", "shingle"))).alias("parts"), F.count_if("hot").alias("often")
    )
    taken = (F.col("size") - F.ceil(F.col("size") * F.lit(least)) + 1).cast("int")
    first = parts.withColumn("parts", F.slice("parts", F.lit(1), taken))
    last = F.size(F.filter("parts", lambda p: p["hot"])).alias("last")
    # A set that is similar to another by frequent shingles alone has ``least`` of its own among these.
    worth = (~F.col("hot")) | (F.col("often") >= F.lit(least) * F.col("size") - F.lit(1e-6))
    return first.select("id", "loose", "size", "often", last, F.inline("parts")).filter(worth)


def _loose_links(here: DataFrame, sets: DataFrame, links: DataFrame, least: float, block: int) -> DataFrame:
    """``links`` and those between the sets ``here`` (id, loose) that are not connected yet, of which one is loose.

    Two similar sets share one of their first shingles in any one order. Frequent shingles come last in it, so that others list
    few pairs; sets whose first common shingle is a frequent one have only frequent ones in common and must have many of them.
    Before such pairs are listed, each set is held against the one of its size that has the fewest shingles of its own, for each
    of its frequent ones: edited copies of one text are nearly all connected by then, however many they are.
    """
    tokens = stable(_first_shingles(here, sets, least, block))
    scale = F.floor(F.log("size") / F.lit(math.log(1 / least))) if least < 1 else F.col("size")
    hot = tokens.filter("hot").withColumn("scale", scale)
    one = F.min_by(F.struct("id", "size", "often"), F.struct(F.col("size") - F.col("often"), "id")).alias("one")
    central = hot.groupBy("shingle", "scale").agg(one)
    met = hot.join(central, ["shingle", "scale"]).filter((F.col("id") != F.col("one.id")) & _like("", "one.", least) & _often_enough("", "one.", least))
    stars = stable(met.select(F.least("id", "one.id").alias("a"), F.greatest("id", "one.id").alias("b")).distinct().join(links, ["a", "b"], "left_anti"))
    links = stable(links.unionByName(similar_pairs(stars, sets, least)))
    # From here on only sets of different components count.
    placed = tokens.join(connected(links).withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("component", "id"))
    several = placed.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max("loose").alias("any"))
    placed = stable(placed.join(several.filter("low <> high and any").select("shingle"), "shingle"))
    x, y = (placed.select("shingle", "hot", F.struct("id", "class", "loose", "size", "often", "last").alias(n)) for n in "xy")
    enough = _often_enough("x.", "y.", least)
    met = x.join(y.drop("hot"), "shingle").filter(
        (F.col("x.class") < F.col("y.class")) & (F.col("x.loose") | F.col("y.loose")) & _like("x.", "y.", least) & (~F.col("hot") | enough)
    )
    # What two sets share is shared by their first shingles or stands behind those of the larger set.
    unlisted = F.when(enough, 0).otherwise(F.least("x.last", "y.last")).alias("u")
    ids = (F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    counted = met.select(*ids, F.col("x.size").alias("m"), F.col("y.size").alias("n"), unlisted).groupBy("a", "b", "m", "n", "u").agg(F.count("*").alias("c"))
    most = F.least(F.col("c") + F.col("u") + F.ceil(F.lit(least) * F.greatest("m", "n")) - 1, "m", "n")
    rest = stable(counted.filter(most >= F.lit(least) * (F.col("m") + F.col("n") - most)).select("a", "b"))
    return links.unionByName(stable(similar_pairs(rest, sets, least))).distinct()


def near_classes(
    signals: DataFrame,
    text: str = "text",
    signal_id: str = "signal_id",
    words: int = WORDS,
    least: float = LEAST,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """(signal_id, class_id): the least id of the signals reachable over equal and near-equal texts.

    A signal with a null or blank text is a class of its own. Repeated rows of an id give a row each.
    """
    if not 0 < least <= 1:
        raise ValueError("the least similarity lies above 0 and is at most 1")
    # Texts are read once and never shuffled; from here on only hashes are.
    folded = signals.select(F.monotonically_increasing_id().alias("_row"), F.col(signal_id).alias("id"), fold_text(text).alias("_text"))
    kind = dict(folded.dtypes)["id"]
    made = f"_row bigint, id {kind}, _key string, shingles array<bigint>, minima array<bigint>"
    hashed = stable(folded.mapInArrow(_hashed_texts(words, bands, rows), made))
    first = F.min(F.struct(F.isnull("id").alias("_no"), "id", "_row")).alias("first")
    firsts = hashed.filter("_key is not null").groupBy("_key").agg(first, F.count("*").alias("_n"))
    texts = stable(firsts.select("_key", "first.id", "first._row", "_n"))
    sets = hashed.select(F.col("_row").alias("id"), "shingles")
    values = hashed.select("_row", "minima").join(texts.select("_row"), "_row", "left_semi").select(F.col("_row").alias("id"), F.posexplode("minima").alias("band", "value"))
    links = near_links(sets, least, bands, rows, block, values)
    names = texts.select("_row", "id")
    classes = connected(links.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").select("x", "y"))
    found = texts.join(classes, F.col("id") == F.col("node"), "left")
    keyed = stable(found.select("_key", "_n", F.coalesce("component", "id").alias("class_id")))
    # Copies of one text may be a third of all signals: the most copied texts are looked up.
    all_keys = hashed.select("id", F.coalesce("_key", F.lit("")).alias("_key"))
    joined = heavy_first_join(all_keys, keyed, "_key", "class_id", "_n", "id")
    return joined.select(F.col("id").alias("signal_id"), F.coalesce("class_id", "id").alias("class_id"))


def near_copies_of(signals: DataFrame, **options) -> DataFrame:
    """Ledger of dropped signals: (signal_id, duplicate_of) for every equal or near copy."""
    classes = near_classes(signals, **options)
    return classes.filter("signal_id <> class_id").select("signal_id", F.col("class_id").alias("duplicate_of"))


def dedup_near_signals(signals: DataFrame, signal_id: str = "signal_id", **options) -> DataFrame:
    """The signals with the least id of each class of near copies, with all their columns."""
    dropped = near_copies_of(signals, signal_id=signal_id, **options).select(F.col("signal_id").alias(signal_id))
    return signals.join(dropped, signal_id, "left_anti")
