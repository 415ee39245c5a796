"""Ratings, score, band and stage per prospect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.config import BUCKETS, COMPANY_TYPES, DIMENSION_LABELS, DISCUSSION_SOURCES, ScoringConfig
from signalsieve.functions.numbers import clamp
from signalsieve.functions.scores import band, stage_class, stage_from_counts, weighted_score
from signalsieve.functions.urls import has_valid_url
from signalsieve.operators.evidence import KEYS

DEFAULT_CONFIG = ScoringConfig()


def entity_profile(evidence: DataFrame, keys: Sequence[str] = KEYS, channels: bool = False) -> DataFrame:
    """All counts the ratings need, in one aggregation per entity.

    Every buffer has a fixed width, so Spark aggregates by hashing and combines on the map
    side; an entity with a third of all signals sends one small row per task. Names, titles
    and texts are fetched later, for shortlisted prospects only.

    Reads buckets, source_type, source_url, signal_date and, where present, reliability
    (percent), ``stale``, ``as_of``, ``disqualified``, ``icp_trigger`` and ``entity_type``. With ``channels``
    the set of linked source types is given instead of their number, so that profiles can be merged.
    """
    columns = set(evidence.columns)
    observed = F.size("buckets") > 0
    linked = observed & F.col("_valid")
    hit = {b: F.array_contains("buckets", b) for b in BUCKETS}
    if "icp_trigger" in columns:
        # A product's own trigger is a reason to act now, as the lexicon's are.
        hit["timing"] = hit["timing"] | F.coalesce("icp_trigger", F.lit(False))
    n_bucket = [F.count_if(found).alias(f"n_{b}") for b, found in hit.items()]
    rated = F.col("reliability") if "reliability" in columns else F.lit(None).cast("int")
    stale = F.col("stale") if "stale" in columns else F.col("signal_date").isNull()
    extras = []
    if "as_of" in columns:
        extras.append(F.max("as_of").alias("as_of"))
    if "disqualified" in columns:
        extras.append(F.bool_or("disqualified").alias("is_disqualified"))
    if "entity_type" in columns:
        extras.append(F.coalesce(F.bool_or(F.col("entity_type").isin(list(COMPANY_TYPES))), F.lit(False)).alias("is_company"))
    channel = F.when(F.col("_valid"), F.col("source_type"))
    reached = F.array_sort(F.collect_set(channel)).alias("channels") if channels else F.count_distinct(channel).alias("n_channels")
    return evidence.withColumn("_valid", has_valid_url("source_url")).groupBy(*keys).agg(
        F.count("*").alias("n_signals"),
        *n_bucket,
        F.count_if(observed).alias("n_observed"),
        F.count_if(linked).alias("n_linked"),
        F.count_if(F.col("signal_date").isNull()).alias("n_undated"),
        F.count_if(stale).alias("n_stale"),
        F.count_if(F.col("source_type").isin(list(DISCUSSION_SOURCES))).alias("n_discussion"),
        F.max("signal_date").alias("newest"),
        F.max(F.when(hit["timing"], F.col("signal_date"))).alias("newest_trigger"),
        F.sum(rated).alias("reliability_sum"),
        F.count(rated).alias("reliability_n"),
        reached,
        *extras,
    )


def fit_counts(evidence: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct ICP terms hit per entity."""
    return (
        evidence.select(*keys, F.explode("fit_terms").alias("_term"))
        .groupBy(*keys)
        .agg(F.count_distinct("_term").alias("n_fit_terms"))
    )


def rate_pain(config: ScoringConfig = DEFAULT_CONFIG) -> Column:
    return F.expr(f"least(5D, (n_pain + n_workaround + n_switching) * {config.pain_per_hit}D)")


def rate_fit(config: ScoringConfig = DEFAULT_CONFIG) -> Column:
    if config.fit_source == "buckets":
        terms = " + ".join(f"cast(n_{b} > 0 AS INT)" for b in BUCKETS)
    else:
        terms = "coalesce(n_fit_terms, 0)"
    return F.expr(f"least(5D, ({terms}) * {config.fit_per_term}D + {config.fit_base}D)")


def rate_timing(config: ScoringConfig = DEFAULT_CONFIG) -> Column:
    """Step function of the newest signal's age, raised by a current trigger.

    An old request rates low here and stays a prospect.
    """
    steps = " ".join(
        f"WHEN date_diff(as_of, newest) <= {oldest} THEN {rating}" for oldest, rating in config.timing_steps
    )
    current = f"date_diff(as_of, newest_trigger) <= {config.trigger_days}"
    return F.expr(
        f"""least(5D, cast(
            CASE WHEN newest IS NULL THEN {config.timing_undated} {steps} ELSE {config.timing_older} END
            + CASE WHEN {current} THEN {config.trigger_bonus} ELSE 0 END AS DOUBLE))"""
    )


def rate_reachability(config: ScoringConfig = DEFAULT_CONFIG) -> Column:
    return F.expr(f"least(5D, n_channels * {config.reach_per_channel}D)")


def rate_evidence(config: ScoringConfig = DEFAULT_CONFIG) -> Column:
    """Mean source reliability blended with the number of signals."""
    percent = f"""(coalesce(reliability_sum, 0)
        + (n_signals - reliability_n) * {config.default_reliability}) / n_signals"""
    return F.expr(
        f"""least(5D, {percent} * {config.reliability_weight / 20.0}D
            + n_signals * {config.evidence_per_signal}D + {config.evidence_base}D)"""
    )


def rate_prospects(
    profile: DataFrame, config: ScoringConfig = DEFAULT_CONFIG, as_of: Column | None = None
) -> DataFrame:
    """Adds dimensions, score, band, stage and stage_class to an entity profile."""
    rated = profile if as_of is None else profile.withColumn("as_of", as_of)
    dimensions = F.struct(
        rate_pain(config).alias("pain_strength"),
        rate_fit(config).alias("product_fit"),
        rate_timing(config).alias("timing"),
        rate_reachability(config).alias("reachability"),
        rate_evidence(config).alias("evidence_quality"),
    )
    return score_dimensions(rated.withColumn("dimensions", dimensions)).withColumn(
        "stage",
        stage_from_counts(*(F.col(f"n_{b}") for b in BUCKETS)),
    ).withColumn("stage_class", stage_class("stage"))


def score_dimensions(prospects: DataFrame) -> DataFrame:
    """Adds ``score`` and ``band`` from the ``dimensions`` struct."""
    ratings = {name: f"dimensions.{name}" for name in DIMENSION_LABELS}
    return prospects.withColumn("score", weighted_score(**ratings)).withColumn("band", band("score"))


def score_prospects(
    evidence: DataFrame, config: ScoringConfig = DEFAULT_CONFIG, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Profile, fit and ratings in one go; evidence needs ``as_of``."""
    profile = entity_profile(evidence, keys)
    if config.fit_source == "icp":
        # Both sides are already hashed on the keys, so this join adds no shuffle.
        profile = profile.join(fit_counts(evidence, keys), list(keys), "left")
    return rate_prospects(profile, config)


def dimension_breakdown(prospects: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Five rows per prospect, in fixed order: dimension, label, rating 0-5 and bar percent."""
    entries = F.array(
        *(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("dimension"),
                F.lit(label).alias("label"),
                clamp(F.col(f"dimensions.{name}"), 5).alias("rating"),
            )
            for i, (name, label) in enumerate(DIMENSION_LABELS.items(), 1)
        )
    )
    return prospects.select(*keys, F.inline(entries)).withColumn("bar_percent", F.col("rating") * 20)


def reconcile_scores(prospects: DataFrame) -> DataFrame:
    """Reported score beside the one its dimensions give; needs reported_score and dimensions."""
    computed = score_dimensions(prospects)
    return (
        computed.withColumnRenamed("score", "computed_score")
        .withColumnRenamed("band", "computed_band")
        .withColumn("reported_band", band("reported_score"))
        .withColumn("delta", F.col("computed_score") - F.col("reported_score"))
        .withColumn("mismatch", F.col("delta") != 0)
        .withColumn("band_changed", F.col("computed_band") != F.col("reported_band"))
    )
