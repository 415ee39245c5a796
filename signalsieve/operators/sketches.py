"""Distinct prospects behind patterns and coverage, counted by sketches that can be merged.

A sketch per product, bucket and day is a few kilobytes at most, whatever the number of signals, and the union of
sketches counts a prospect once however many days it is seen on. So any span of days is counted from
the stored sketches, without the signals. Estimates of the same prospects by other batches differ a
little, within the stated error; hits are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.operators.evidence import bucket_hits
from signalsieve.sources.keyed_tables import BUCKETS as TABLE_BUCKETS
from signalsieve.sources.keyed_tables import merge_keyed

#: Logarithm of a sketch's slots: the error of a count is 0.83 / sqrt(2 ** 12), 1.3 per cent, in two of three cases.
SLOTS = 12
_CELL = ("bucket", "day")


def relative_error(slots: int = SLOTS) -> float:
    """The standard error of a count, as a share of it."""
    return 0.83 / 2 ** (slots / 2)


def daily_sketches(evidence: DataFrame, keys: Sequence[str] = ("product_id",), slots: int = SLOTS) -> DataFrame:
    """One row per product, bucket and day (NULL for undated signals): n_hits and a sketch of the prospects.

    Sketches are begun in each task and merged after the shuffle, so a hot product sends one per task.
    """
    hits = bucket_hits(evidence.select(*keys, "entity_key", "buckets", F.to_date("signal_date").alias("day")))
    prospect = F.col("entity_key").cast("string")
    return hits.filter("entity_key is not null").groupBy(*keys, *_CELL).agg(
        F.count("*").alias("n_hits"), F.hll_sketch_agg(prospect, slots).alias("prospects")
    )


def fold_sketches(sketches: DataFrame, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """One row per product, bucket and day from rows of any number of batches."""
    return sketches.groupBy(*keys, *_CELL).agg(F.sum("n_hits").alias("n_hits"), F.hll_union_agg("prospects").alias("prospects"))


def refresh_sketches(
    path: str, evidence: DataFrame, batch: int, keys: Sequence[str] = ("product_id",), buckets: int = TABLE_BUCKETS
) -> list[int]:
    """Adds a batch of signals to the table of sketches at ``path``; returns the buckets rewritten."""
    return merge_keyed(path, daily_sketches(evidence, keys), [*keys, *_CELL], lambda rows: fold_sketches(rows, keys), batch, buckets)


def estimated_patterns(
    sketches: DataFrame, keys: Sequence[str] = ("product_id",), days: Column | None = None
) -> DataFrame:
    """Hits and the estimated number of prospects per product and bucket over all days, or those for which
    ``days`` holds."""
    chosen = sketches if days is None else sketches.filter(days)
    return chosen.groupBy(*keys, "bucket").agg(
        F.sum("n_hits").alias("n_hits"), F.hll_sketch_estimate(F.hll_union_agg("prospects")).alias("n_prospects")
    )
