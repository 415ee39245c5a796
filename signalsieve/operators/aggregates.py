"""Report figures: counts, patterns, verdicts, distributions and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalsieve.config import DEFAULT_LIMIT, PATTERN_COUNT_LIMIT
from signalsieve.functions.numbers import clamp
from signalsieve.functions.scores import is_high_intent
from signalsieve.operators.evidence import bucket_hits


def half_even_mean(column: str) -> Column:
    """Mean of an integer column, rounded half to even; 0 without rows."""
    return F.coalesce(F.bround(F.sum(column) / F.count(column), 0).cast("int"), F.lit(0))


def report_kpis(
    prospects: DataFrame, products: DataFrame, keys: Sequence[str] = ("product_id",)
) -> DataFrame:
    """Prospect count, high-intent count, mean score and best reachability per product.

    Every product of ``products`` has a row, also one without prospects.
    """
    figures = prospects.groupBy(*keys).agg(
        F.count("*").alias("n_prospects"),
        F.count_if(is_high_intent("stage")).alias("n_high_intent"),
        half_even_mean("score").alias("average_score"),
        F.max("dimensions.reachability").alias("best_reachability"),
    )
    return products.select(*keys).join(figures, list(keys), "left").na.fill(
        0, ["n_prospects", "n_high_intent", "average_score", "best_reachability"]
    )


def verdict(kpis: DataFrame) -> DataFrame:
    """Adds ``verdict_flag``: whether the product has reachable early-customer signals."""
    return kpis.withColumn(
        "verdict_flag",
        F.when(
            (F.col("n_prospects") >= 3) & (F.col("n_high_intent") >= 1) & (F.col("best_reachability") >= 3),
            F.lit("reachable"),
        )
        .when(F.col("n_prospects") >= 1, F.lit("emerging"))
        .otherwise(F.lit("none")),
    )


def patterns(
    evidence: DataFrame,
    keys: Sequence[str] = ("product_id",),
    least: int = 2,
    samples: int = 3,
    sample_column: str = "signal_id",
) -> DataFrame:
    """Buckets seen at two or more prospects of a product, most frequent first.

    Spark counts the distinct prospects in two steps, first by (product, bucket, prospect), so
    a product with a third of all signals is spread out. The samples are the first few ids per
    product and bucket, cut per task before the shuffle; no list grows with the data.
    """
    wanted = [*keys, "entity_key", "buckets", *dict.fromkeys(["signal_id", sample_column])]
    hits = bucket_hits(evidence.select(*wanted))
    counts = (
        hits.groupBy(*keys, "bucket")
        .agg(F.count_distinct("entity_key").alias("n_entities"))
        .filter(F.col("n_entities") >= least)
        .select(*keys, "bucket", clamp("n_entities", PATTERN_COUNT_LIMIT).alias("count"), "n_entities")
    )
    first = Window.partitionBy(*keys, "bucket").orderBy("signal_id")
    sampled = (
        hits.withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= samples)
        .groupBy(*keys, "bucket")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("_n", F.col(sample_column).alias("_sample")))),
                lambda s: s["_sample"].cast("string"),
            ).alias("samples")
        )
    )
    by_count = Window.partitionBy(*keys).orderBy(F.col("n_entities").desc(), F.col("bucket"))
    # At most one row per bucket reaches this window.
    return counts.join(sampled, [*keys, "bucket"]).withColumn("rank", F.row_number().over(by_count)).drop("n_entities")


def distribution(prospects: DataFrame, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """Prospects per band and stage of each product, with totals by band, by stage and overall.

    The grouping sets run over the few (band, stage) cells of a product, not over prospects.
    """
    product = list(keys)
    cells = prospects.groupBy(*product, "band", "stage").agg(F.count("*").alias("_n"))
    sets = [[*product, "band", "stage"], [*product, "band"], [*product, "stage"], product]
    return cells.groupingSets(
        [[F.col(c) for c in s] for s in sets], *(F.col(c) for c in (*product, "band", "stage"))
    ).agg(
        F.sum("_n").alias("n_prospects"),
        (F.grouping("band") * 2 + F.grouping("stage")).cast("int").alias("level"),
    )


def limits(
    prospects: DataFrame, products: DataFrame, keys: Sequence[str] = ("product_id",)
) -> DataFrame:
    """What is missing behind a product's prospects, as counts and as sentences."""
    counts = prospects.groupBy(*keys).agg(
        F.count_if(F.col("n_undated") > 0).alias("n_undated_prospects"),
        F.count_if(F.col("n_observed") == 0).alias("n_inferred_only"),
        F.count_if(F.col("n_channels") <= 1).alias("n_single_source"),
        F.count_if(F.col("n_stale") == F.col("n_signals")).alias("n_stale_only"),
    )
    names = {
        "n_undated_prospects": "%d prospects have a signal without a visible date.",
        "n_inferred_only": "%d prospects rest on inference alone.",
        "n_single_source": "%d prospects rest on one kind of source.",
        "n_stale_only": "%d prospects have only stale evidence.",
    }
    filled = products.select(*keys).join(counts, list(keys), "left").na.fill(0, list(names))
    notes = F.array_compact(
        F.array(*(F.when(F.col(c) > 0, F.format_string(text, F.col(c))) for c, text in names.items()))
    )
    return filled.withColumn(
        "limits", F.when(F.size(notes) > 0, notes).otherwise(F.array(F.lit(DEFAULT_LIMIT)))
    )
