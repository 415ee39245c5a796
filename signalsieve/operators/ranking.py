"""Gates, reasons for rejection, ranks and shortlists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalsieve.config import (
    DEFAULT_MODE,
    LARGEST_SHORTLIST,
    MODES,
    NO_PROSPECT,
    POTENTIAL_FIT,
    PRIMARY_FLOOR,
)
from signalsieve.operators.evidence import KEYS
from signalsieve.operators.skew import ranked_rows, salted_join


_FLAGS = (
    ("is_duplicate", "duplicate"),
    ("is_disqualified", "disqualified"),
    ("is_blocked", "policy"),
)


def rejection_reasons(columns: Sequence[str]) -> Column:
    """Why a prospect is kept out of the primary shortlist; empty when it qualifies.

    ``n_observed`` and ``n_linked`` count its cited signals and those with a valid URL. The
    ``is_duplicate``, ``is_disqualified`` and ``is_blocked`` flags are used where present.
    """
    checks = [
        F.when(F.col("n_observed") < 1, F.lit("no_signal")),
        F.when(F.col("n_linked") < 1, F.lit("bad_url")),
        F.when(F.col("score") < PRIMARY_FLOOR, F.lit("low_score")),
        F.when(F.col("stage") == POTENTIAL_FIT, F.lit("potential_fit")),
    ]
    for flag, reason in _FLAGS:
        if flag in columns:
            checks.append(F.when(F.col(flag), F.lit(reason)))
    return F.array_compact(F.array(*checks))


def _qualifies(columns: Sequence[str]) -> Column:
    """The same rules as a plain condition, which is cheap wherever Spark moves it."""
    holds = (
        (F.col("n_observed") >= 1)
        & (F.col("n_linked") >= 1)
        & (F.col("score") >= PRIMARY_FLOOR)
        & (F.col("stage") != POTENTIAL_FIT)
    )
    for flag, _ in _FLAGS:
        if flag in columns:
            holds = holds & ~F.coalesce(F.col(flag), F.lit(False))
    return holds


def primary_gate(prospects: DataFrame) -> DataFrame:
    """Prospects with a cited and linked signal, a score of at least 50 and a real stage."""
    return prospects.filter(_qualifies(prospects.columns))


def rejections(prospects: DataFrame) -> DataFrame:
    """The complement of :func:`primary_gate`, with every reason."""
    rejected = prospects.filter(~_qualifies(prospects.columns))
    return rejected.withColumn("reasons", rejection_reasons(prospects.columns))


def dropped_entities(
    signals: DataFrame, prospects: DataFrame, copies: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Entities whose signals all fell out before scoring, with the reasons.

    The signals' own ``reason`` values when every signal has one (``policy`` for a signal that is
    only marked ``is_blocked``), ``duplicate`` when the others were copies of an earlier signal
    (``copies`` from :func:`copies_of`), else ``no_signal``.
    """
    marked = signals
    if "reason" not in signals.columns:
        marked = marked.withColumn("reason", F.when(F.col("is_blocked"), F.lit("policy")))
    if copies is not None:
        marked = marked.join(
            copies.select("signal_id", F.lit(True).alias("_copy")), "signal_id", "left"
        )
    else:
        marked = marked.withColumn("_copy", F.lit(False))
    blocked = F.col("reason").isNotNull()
    entities = marked.groupBy(*keys).agg(
        F.array_sort(F.collect_set("reason")).alias("_own"),
        F.bool_and(blocked).alias("_policy"),
        F.bool_and(blocked | F.coalesce("_copy", F.lit(False))).alias("_duplicate"),
    )
    reason = (
        F.when(F.col("_policy"), F.col("_own"))
        .when(F.col("_duplicate"), F.array(F.lit("duplicate")))
        .otherwise(F.array(F.lit("no_signal")))
    )
    # One row per entity on both sides by now.
    return (
        entities.join(prospects.select(*keys), list(keys), "left_anti")
        .withColumn("reasons", reason)
        .drop("_policy", "_duplicate", "_own")
    )


def mode_priority(mode: Column) -> Column:
    """Leading sort key per mode: 0 is what the mode looks for first."""
    feedback = (F.col("n_pain") + F.col("n_workaround")) > 0
    buying = (F.col("n_explicit_demand") + F.col("n_switching")) > 0
    company = F.coalesce("is_company", F.lit(False))
    trigger = F.col("n_timing") > 0
    request = F.col("n_explicit_demand") > 0
    discussed = F.col("n_discussion") > 0

    def two_tests(first: Column, second: Column) -> Column:
        return (
            F.when(first & second, F.lit(0)).when(first, F.lit(1)).when(second, F.lit(2)).otherwise(F.lit(3))
        )

    return (
        F.when(mode == "design-partners", two_tests(feedback, ~buying))
        .when(mode == "b2b", two_tests(company, trigger))
        .when(mode == "community", two_tests(request, discussed))
        .otherwise(F.lit(0))
    )


def with_mode(prospects: DataFrame, briefs: DataFrame) -> DataFrame:
    """Adds each product's ``mode``; a missing or unknown one is the default."""
    known = F.when(F.col("mode").isin(list(MODES)), F.col("mode")).otherwise(F.lit(DEFAULT_MODE))
    modes = briefs.select("product_id", known.alias("mode"))
    return salted_join(
        prospects.drop("mode"), modes, ["product_id"], how="left", spread_on=["entity_key"]
    ).withColumn("mode", F.coalesce("mode", F.lit(DEFAULT_MODE)))


def prioritise(prospects: DataFrame, briefs: DataFrame) -> DataFrame:
    """Adds ``mode`` and ``priority``; uses ``is_company`` where present."""
    typed = prospects if "is_company" in prospects.columns else prospects.withColumn("is_company", F.lit(False))
    return with_mode(typed, briefs).withColumn("priority", mode_priority(F.col("mode")))


def _order(columns: Sequence[str]) -> list[Column]:
    leading = [F.col("priority").asc()] if "priority" in columns else []
    return [*leading, F.col("score").desc(), F.col("dimensions.timing").desc(), F.col("entity_key").asc()]


def rank_all(prospects: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rank of every prospect within its product, whatever the size of the product."""
    flat = prospects.withColumn("_timing", F.col("dimensions.timing"))
    leading = [F.col("priority").asc()] if "priority" in prospects.columns else []
    order = [*leading, F.col("score").desc(), F.col("_timing").desc(), F.col("entity_key").asc()]
    return ranked_rows(flat, ["product_id"], order, partitions=partitions).drop("_timing")


def rank_top(prospects: DataFrame, most: int = LARGEST_SHORTLIST) -> DataFrame:
    """The best ``most`` prospects per product, ranked from 1.

    The literal bound lets Spark cut each product to ``most`` rows per task before the shuffle.
    """
    window = Window.partitionBy("product_id").orderBy(*_order(prospects.columns))
    return prospects.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= most)


def shortlist(prospects: DataFrame, briefs: DataFrame) -> DataFrame:
    """Qualified prospects per product, ordered for its mode and cut at the mode's number."""
    cap = F.coalesce(
        *(F.when(F.col("mode") == mode, F.lit(most)) for mode, most in MODES.items()),
        F.lit(MODES[DEFAULT_MODE]),
    )
    ranked = rank_top(prioritise(primary_gate(prospects), briefs))
    return ranked.filter(F.col("rank") <= cap)


def top_prospect(
    prospects: DataFrame,
    products: DataFrame,
    keys: Sequence[str] = ("product_id",),
    position: str = "input_position",
    score: str = "score",
) -> DataFrame:
    """Best score per product, first in input order on ties; every product gets a row.

    The text is why_now, or pain_signal for a prospect without a why_now of its own.
    """
    columns = prospects.columns
    why_now = F.col("why_now") if "why_now" in columns else F.lit(None).cast("string")
    pain = F.col("pain_signal") if "pain_signal" in columns else F.lit("")
    window = Window.partitionBy(*keys).orderBy(F.col("_score").desc(), F.col("_position").asc())
    best = (
        prospects.select(
            *keys,
            F.col("entity_name").alias("top_name"),
            F.coalesce(why_now, pain).alias("top_text"),
            F.col(score).alias("_score"),
            F.col(position).alias("_position"),
        )
        .withColumn("_n", F.row_number().over(window))
        .filter(F.col("_n") == 1)
        .drop("_n", "_position")
        .withColumnRenamed("_score", "top_score")
    )
    return products.select(*keys).join(best, list(keys), "left").select(
        *keys,
        F.coalesce("top_name", F.lit(NO_PROSPECT)).alias("top_name"),
        F.coalesce("top_score", F.lit(0)).alias("top_score"),
        F.coalesce("top_text", F.lit("")).alias("top_text"),
    )
