"""Product briefs: completeness and scope."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.config import BRIEF_FIELDS
from signalsieve.operators.skew import salted_join


def brief_readiness(briefs: DataFrame) -> DataFrame:
    """Adds ``missing`` (names of the facts not stated) and ``ready``.

    Geography and language are one requirement: either satisfies it.
    """

    def absent(name: str) -> Column:
        if dict(briefs.dtypes)[name].startswith("array"):
            return F.col(name).isNull() | (F.size(name) <= 0)
        return F.col(name).isNull() | (F.trim(name) == "")

    gaps = [F.when(absent(name), F.lit(name)) for name in BRIEF_FIELDS]
    gaps.append(F.when(absent("geography") & absent("lang"), F.lit("geography_or_language")))
    return briefs.withColumn("missing", F.array_compact(F.array(*gaps))).withColumn(
        "ready", F.size("missing") == 0
    )


def in_scope(
    signals: DataFrame, briefs: DataFrame, not_before: dt.date | None = None, keep_old: bool = False
) -> DataFrame:
    """Signals within each product's language and time window, with age columns.

    ``briefs`` needs product_id, as_of, scope_months and, to filter by language, lang.
    Undated signals stay and are marked stale; signals of unknown language stay.
    With ``keep_old`` signals from before the window stay too, marked stale. ``not_before`` is an optional
    earliest date over all briefs; unlike the per-product window it reaches the file scan.
    """
    if not_before is not None:
        signals = signals.filter(
            F.col("signal_date").isNull() | (F.col("signal_date") >= F.lit(not_before))
        )
    wanted = ["product_id", "as_of", "scope_months"]
    by_language = "lang" in signals.columns and "lang" in briefs.columns
    if by_language:
        wanted.append(F.col("lang").alias("_brief_lang"))
    joined = salted_join(
        signals, briefs.select(*wanted), ["product_id"], spread_on=["signal_id"]
    )
    recent = F.col("signal_date") >= F.add_months("as_of", -F.col("scope_months"))
    keep = F.col("signal_date").isNull() | (
        (F.lit(keep_old) | recent) & (F.col("signal_date") <= F.col("as_of"))
    )
    if by_language:
        known = F.col("_brief_lang").isNotNull() & F.col("lang").isNotNull()
        keep = keep & (~known | (F.col("lang") == F.col("_brief_lang")))
    return freshness(joined.filter(keep).drop("_brief_lang"))


def freshness(evidence: DataFrame) -> DataFrame:
    """Adds ``age_days`` and ``stale``: older than the scope, or without a date.

    Needs signal_date, as_of and scope_months.
    """
    undated = F.col("signal_date").isNull()
    too_old = F.col("signal_date") < F.add_months("as_of", -F.col("scope_months"))
    return evidence.withColumn("age_days", F.date_diff("as_of", "signal_date")).withColumn(
        "stale", undated | too_old
    )
