"""Mixing of sources to target weights by pivotal dependent rounding.

Every document has an expected number of copies, its source's target over its source's size. The
whole part is certain; the fraction is rounded so that the words taken from a source stay what
they should be: two documents with open fractions exchange mass, in words, until one of them is
in or out. The sum never changes and each document keeps its expectation. Documents are paired
within buckets of bounded size; what one bucket leaves open, one document at most, meets what other
buckets leave open in a reduction tree, so no task ever holds a whole source.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalsieve.llm.common import LOCATOR, fresh, full_text, importable, located, words, written

BUCKET_ROWS = 4096
FAN_IN = 64

#: Parts that the rows of one unit are ranked in.
RANK_PARTS = 64

UNITS = "doc_id long, source string, text_key long, n long, mass double, open double, base int, sure long, bucket long, ord long"


def source_targets(
    sources: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    Sources take the weights in turn, by code point with null last, and share ``share`` of all
    sizes by weight. A target stops at ``cap`` times the source's size and the excess is shared
    again by weight until none is above. That is the level L at which the sum of
    min(cap * size, L * weight) is the total: sources are filled in order of cap * size / weight,
    and L follows from running sums. The windows run over one row per source, never over documents.
    """
    everything = Window.partitionBy()
    turn = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int"))
    filled = everything.orderBy("_fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("_total") - F.coalesce(F.sum("_most").over(filled), F.lit(0.0))
    rest_weight = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(filled), F.lit(0.0))
    return (
        sources.withColumn("_weight", weight)
        .withColumn("_most", F.col("source_size") * float(cap))
        .withColumn("_fill", F.col("_most") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything) * float(share))
        .withColumn("_level", rest / rest_weight)
        # The first source that the level does not fill sets it for all after it; later ones,
        # which leave out sources that it does not fill, come out lower.
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_fill"), F.col("_level"))).over(everything))
        .withColumn("target", F.least("_most", F.coalesce(F.col("_level") * F.col("_weight"), F.col("_most"))))
        .drop("_weight", "_most", "_fill", "_total", "_level")
    )


def _settle(part: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """Pairs the open rows of one bucket; at most one stays open, and none if ``last``.

    Large rows come first: many small ones settle them, and what stays open in the end is small.
    """
    part = part.sort_values(["mass", "ord", "doc_id"], ascending=False, kind="stable", ignore_index=True)
    mass, value = part["mass"].to_numpy(), part["open"].to_numpy().copy()
    rows = np.flatnonzero((value > 0) & (value < mass))
    draw = np.random.default_rng([seed, int(part["ord"].iloc[0]) & (2**63 - 1), len(part)]).random(len(rows) + 1)
    held = -1
    for i, luck in zip(rows, draw):
        if held < 0:
            held = i
            continue
        to_held = min(mass[held] - value[held], value[i])
        to_i = min(value[held], mass[i] - value[i])
        if luck * (to_held + to_i) < to_i:
            full = mass[held] - value[held] <= value[i]
            value[i] = 0.0 if not full else value[i] - to_held
            value[held] = mass[held] if full else value[held] + to_held
        else:
            full = mass[i] - value[i] <= value[held]
            value[held] = 0.0 if not full else value[held] - to_i
            value[i] = mass[i] if full else value[i] + to_i
        for j in (held, i):
            if value[j] <= 1e-9 * mass[j]:
                value[j] = 0.0
            elif value[j] >= (1 - 1e-9) * mass[j]:
                value[j] = mass[j]
        still = [j for j in (held, i) if 0 < value[j] < mass[j]]
        held = still[0] if still else -1
    if last and held >= 0:
        value[held] = mass[held] if draw[-1] * mass[held] < value[held] else 0.0
    return part.assign(open=value)


def _settler(seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda part: _settle(part, seed, last)


def _text_key(text: str) -> Column:
    return F.xxhash64(full_text(text))


def _same(left: list[Column], right: list[Column]) -> Column:
    """Equal keys, nulls included, which Spark joins by hash or sort."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right)))


def _lucky(rows: DataFrame) -> DataFrame:
    """Locators of the ``more`` first rows of each unit. A unit's rows are counted in parts and ranked within them."""
    key = ["doc_id", "source", "text_key"]
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*LOCATOR), F.lit(RANK_PARTS)))
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*key, "part").agg(F.count("*").alias("here"))
    parts = parts.withColumn("before", F.coalesce(F.sum("here").over(earlier), F.lit(0)))
    parts = parts.select(*(F.col(c).alias(f"_{c}") for c in [*key, "part"]), "before")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*key, "part").orderBy(*LOCATOR)))
    both = [*key, "part"]
    return (
        ranked.join(parts, _same([F.col(c) for c in both], [F.col(f"_{c}") for c in both]))
        .filter(F.col("before") + F.col("rank") <= F.col("more"))
        .select(*LOCATOR)
    )


def _row_copies(
    narrow: DataFrame, weights: Sequence[float], share: float, cap: float, seed: int, bucket_rows: int, fan_in: int
) -> tuple[DataFrame, DataFrame]:
    """Locator, unit, size and copies of each row of ``narrow`` (doc_id, text, source, locator); and the sources."""
    importable(narrow.sparkSession)
    key = ["doc_id", "source", "text_key"]
    sized = written(
        narrow.select(
            *LOCATOR,
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            _text_key("text").alias("text_key"),
            F.size(words(full_text())).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    sources = written(
        source_targets(
            sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), weights, share, cap
        ).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)),
        "mix-targets",
    )
    rated = sources.select(F.col("source").alias("_source"), "rate", "_rows")
    extra = F.col("n") * (F.col("rate") - F.floor("rate"))
    level = (
        sized.groupBy(*key, "size")
        .agg(F.count("*").alias("n"))
        .join(rated, F.col("source").eqNullSafe(F.col("_source")))
        .select(
            *key,
            "n",
            F.col("size").cast("double").alias("mass"),
            (F.col("size") * (extra - F.floor(extra))).alias("open"),
            F.floor("rate").cast("int").alias("base"),
            F.floor(extra).cast("long").alias("sure"),
            F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_key"), F.ceil(F.col("_rows") / bucket_rows)).cast("long").alias("bucket"),
            F.xxhash64("doc_id", "text_key", F.lit(seed)).alias("ord"),
        )
    )
    largest = sources.agg(F.max("_rows")).first()[0] or 0
    buckets, step, settled = max(1, -(-largest // bucket_rows)), 0, []
    while True:
        last = buckets <= 1
        done = written(level.groupBy("source", "bucket").applyInPandas(_settler(seed + step, last), UNITS), f"mix-{step}")
        is_open = (F.col("open") > 0) & (F.col("open") < F.col("mass"))
        settled.append(done.filter(~is_open))
        if last:
            break
        level = done.filter(is_open).withColumn("bucket", F.floor(F.col("bucket") / fan_in))
        buckets, step = -(-buckets // fan_in), step + 1
    decided = reduce(DataFrame.unionByName, settled).select(
        *(F.col(c).alias(f"_{c}") for c in key),
        "n",
        "base",
        (F.col("sure") + F.when((F.col("mass") > 0) & (F.col("open") >= F.col("mass")), 1).otherwise(0)).alias("more"),
    )
    rows = sized.join(decided, _same([F.col(c) for c in key], [F.col(f"_{c}") for c in key])).drop(*(f"_{c}" for c in key))
    parted = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    if not decided.filter(parted).limit(1).isEmpty():
        rows = written(rows, "mix-rows")
        lucky = _lucky(rows.filter(parted)).withColumn("_first", F.lit(True))
        ranked = rows.filter(parted).join(lucky, LOCATOR, "left").withColumn("more", F.when(F.col("_first"), F.col("n")).otherwise(0)).drop("_first")
        rows = rows.filter(~parted).unionByName(ranked)
    copies = F.col("base") + F.when(F.col("more") > 0, 1).otherwise(0)
    return rows.select(*LOCATOR, *key, "size", copies.alias("copies")), sources


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 1,
    bucket_rows: int = BUCKET_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """How many copies of each document a mix takes.

    Needs ``doc_id``, ``text`` and ``source``; other columns are not read. Returns one row per row
    of ``docs``: doc_id, source, text_key, size (words; null text: 0), source_size, target, copies,
    taken (copies times size). Rows with the same id, source and text are one unit: the copies that they have
    in common are rounded as a number, so that a source misses its target by the words of one row at most,
    and the rows that get one more differ in nothing else here. An empty table gives an empty result; a source
    without words has target 0 and copies 0. The same rows give the same mix however they are partitioned.
    """
    _, narrow, _ = located(docs, "doc_id", "text", "source")
    rows, sources = _row_copies(narrow, weights, share, cap, seed, bucket_rows, fan_in)
    totals = sources.select(F.col("source").alias("_source"), "source_size", "target")
    return rows.join(totals, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "text_key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 1,
    bucket_rows: int = BUCKET_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in its own columns.

    Which of the rows of one id, source and text come once more is settled by where they lie.
    """
    placed, narrow, names = located(docs, "doc_id", "text", "source")
    rows, _ = _row_copies(narrow, weights, share, cap, seed, bucket_rows, fan_in)
    times, copy = fresh(placed, "_copies", "_copy")
    taken = rows.filter("copies > 0").select(*LOCATOR, "copies").toDF(*names, times)
    return placed.join(taken, names).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
