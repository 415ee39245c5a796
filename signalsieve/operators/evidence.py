"""From classified signals to labelled evidence, coverage and the ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalsieve.config import BUCKETS
from signalsieve.functions.dates import date_label
from signalsieve.functions.urls import has_valid_url, safe_url
from signalsieve.operators.skew import salted_join

KEYS = ("product_id", "entity_key")


def label_evidence(signals: DataFrame) -> DataFrame:
    """Adds ``evidence_kind``: observed with a bucket hit, inferred with an ICP match only.

    A signal with neither says nothing about the product and gets NULL.
    """
    icp_only = (
        (F.size("fit_terms") > 0) if "fit_terms" in signals.columns else F.lit(True)
    )
    return signals.withColumn(
        "evidence_kind",
        F.when(F.size("buckets") > 0, F.lit("observed")).when(icp_only, F.lit("inferred")),
    )


def bucket_hits(evidence: DataFrame) -> DataFrame:
    """One row per (signal, bucket).

    The outer form with a filter on its result, because a plain explode makes Spark filter on
    the array first and so classify each text twice.
    """
    exploded = evidence.withColumn("bucket", F.explode_outer("buckets")).drop("buckets")
    return exploded.filter(F.col("bucket").isNotNull())


def coverage(evidence: DataFrame, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """Hits per bucket for each product and source type, and per product (source_type NULL)."""
    counts = [F.count_if(F.array_contains("buckets", b)).alias(b) for b in BUCKETS]
    by_source = evidence.groupBy(*keys, "source_type").agg(*counts, F.count("*").alias("n_signals"))
    # The totals come from the few rows above, not from a second pass over the evidence.
    sums = [F.sum(c).alias(c) for c in (*BUCKETS, "n_signals")]
    totals = by_source.groupBy(*keys).agg(*sums)
    return by_source.withColumn("is_total", F.lit(False)).unionByName(
        totals.withColumn("source_type", F.lit(None).cast("string")).withColumn(
            "is_total", F.lit(True)
        )
    )


def coverage_gaps(evidence: DataFrame, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """Buckets without a single hit per product, and how many source types were searched."""
    table = coverage(evidence, keys).filter("NOT is_total")
    sums = table.groupBy(*keys).agg(
        *(F.sum(b).alias(b) for b in BUCKETS), F.count("source_type").alias("n_source_types")
    )
    missing = F.array_compact(F.array(*(F.when(F.col(b) == 0, F.lit(b)) for b in BUCKETS)))
    return sums.select(*keys, "n_source_types", missing.alias("missing_buckets"))


def evidence_ledger(
    evidence: DataFrame, shortlist: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Every signal behind each shortlisted prospect, with dates, labels and score breakdown.

    The shortlist has a bounded number of narrow rows per product; evidence of a very busy
    entity is spread by the salted join.
    """
    wanted = [
        *keys,
        *(c for c in ("product_id", "entity_name", "rank") if c in shortlist.columns and c not in keys),
        "score",
        "dimensions",
    ]
    carried = [c for c in evidence.columns if c not in wanted or c in keys]
    joined = salted_join(
        evidence.select(*carried), shortlist.select(*wanted), list(keys), spread_on=["signal_id"]
    )
    warning = F.when(F.col("signal_date").isNull(), F.lit("no date")).when(
        F.col("stale"), F.lit("stale")
    )
    return (
        label_evidence(joined)
        .withColumn("date_label", date_label("signal_date"))
        .withColumn("source_url", safe_url("source_url"))
        .withColumn("freshness_warning", warning)
    )


def best_evidence(ledger: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The one signal to show per prospect: observed, linked, strongest bucket, newest, lowest id.

    Runs on the ledger, so texts and titles are only read for shortlisted prospects.
    """
    strength: Column = F.lit(len(BUCKETS))
    for position, bucket in reversed(list(enumerate(BUCKETS))):
        strength = F.when(F.array_contains("buckets", bucket), F.lit(position)).otherwise(strength)
    window = Window.partitionBy(*keys).orderBy(
        F.col("_observed").desc(),
        F.col("_linked").desc(),
        F.col("_strength"),
        F.col("signal_date").desc_nulls_last(),
        F.col("signal_id"),
    )
    return (
        ledger.withColumn("_observed", F.size("buckets") > 0)
        .withColumn("_linked", has_valid_url("source_url"))
        .withColumn("_strength", strength)
        .withColumn("_n", F.row_number().over(window))
        .filter(F.col("_n") == 1)
        .withColumn("best_bucket", F.get("buckets", F.lit(0)))
        .drop("_observed", "_linked", "_strength", "_n")
    )
