"""Ratings kept up to date: each entity's counts as a mergeable row, so that new signals touch only theirs.

Every count behind the five ratings, the score and the stage is a sum, a newest date or a small set, and any split
of the signals into batches folds to the row that one pass over all of them gives. Dates are kept as
dates: ages, and with them timing, are taken when the table is rated, for any day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalsieve.config import ScoringConfig
from signalsieve.operators.evidence import KEYS
from signalsieve.operators.scoring import DEFAULT_CONFIG, entity_profile, rate_prospects
from signalsieve.sources.keyed_tables import BUCKETS, merge_keyed, read_keyed

_NEWEST = ("newest", "newest_trigger")
_FLAGS = ("is_disqualified", "is_company")
#: Sets of a bounded number of values: source types of an entity, terms of its product's ICP.
_SETS = ("channels", "fit_terms")


def profile_parts(evidence: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One mergeable row per entity of some of its signals."""
    parts = entity_profile(evidence, keys, channels=True).drop("n_stale", "as_of")
    if "fit_terms" in evidence.columns:
        terms = evidence.select(*keys, F.explode("fit_terms").alias("_term")).groupBy(*keys)
        fit = terms.agg(F.array_sort(F.collect_set("_term")).alias("fit_terms"))
        parts = parts.join(fit, list(keys), "left").withColumn("fit_terms", F.coalesce("fit_terms", F.array().cast("array<string>")))
    return parts


def fold_parts(parts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per entity from any rows of :func:`profile_parts`."""

    def folded(name: str):
        if name in _NEWEST:
            return F.max(name)
        if name in _FLAGS:
            return F.bool_or(name)
        if name in _SETS:
            return F.array_sort(F.array_distinct(F.flatten(F.collect_set(name))))
        return F.sum(name)

    return parts.groupBy(*keys).agg(*(folded(c).alias(c) for c in parts.columns if c not in keys))


def refresh_profiles(
    path: str, evidence: DataFrame, batch: int, keys: Sequence[str] = KEYS, buckets: int = BUCKETS
) -> list[int]:
    """Adds a batch of signals to the table of profiles at ``path``; returns the buckets rewritten.

    Signals are counted as they come: copies have to be dropped before.
    """
    return merge_keyed(path, profile_parts(evidence, keys), keys, lambda rows: fold_parts(rows, keys), batch, buckets)


def stored_profiles(spark: SparkSession, path: str, like: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The table of profiles at ``path``; ``like`` is evidence of the kind it was made of."""
    return read_keyed(spark, path, fold_parts(profile_parts(like, keys), keys).schema)


def rated_profiles(profiles: DataFrame, as_of: dt.date, config: ScoringConfig = DEFAULT_CONFIG) -> DataFrame:
    """Stored profiles with ratings, score, band and stage as of a day."""
    counted = profiles.withColumn("n_channels", F.size("channels").cast("long"))
    if "fit_terms" in profiles.columns:
        counted = counted.withColumn("n_fit_terms", F.size("fit_terms"))
    return rate_prospects(counted, config, F.lit(as_of))


def keep_profiles(
    evidence: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = KEYS, buckets: int = BUCKETS
) -> StreamingQuery:
    """Adds all evidence of a stream that is available now to the table of profiles.

    Each micro-batch is one batch of the table; one that ran before a failure is skipped by its number.
    """
    return (
        evidence.writeStream.foreachBatch(lambda rows, batch: refresh_profiles(path, rows, batch, keys, buckets) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
