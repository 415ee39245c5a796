"""Weighted score, bands and stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalsieve.config import (
    BAND_BELOW,
    BAND_FLOORS,
    DIMENSION_WEIGHTS,
    HIGH_INTENT,
    POTENTIAL_FIT,
    PROBLEM_AWARE,
    TRIGGER_PRESENT,
)
from signalsieve.functions.numbers import _col, bounded, clamp


def bounded_rating(value: Column | str) -> Column:
    """Rating kept within [0, 5] without rounding; NULL and NaN give 0."""
    return bounded(value, 5)


def weighted_score(**ratings: Column | str) -> Column:
    """0-100 INT from the five ratings; a rating of 5 everywhere gives 100."""
    terms = [
        bounded_rating(ratings[name]) * F.lit(weight / 5.0)
        for name, weight in DIMENSION_WEIGHTS.items()
    ]
    return clamp(reduce(lambda a, b: a + b, terms), 100)


def band(score: Column | str) -> Column:
    value = _col(score)
    chain = F.when(value >= BAND_FLOORS[0][1], F.lit(BAND_FLOORS[0][0]))
    for name, floor in BAND_FLOORS[1:]:
        chain = chain.when(value >= floor, F.lit(name))
    return chain.otherwise(F.lit(BAND_BELOW))


def stage_class(stage: Column | str) -> Column:
    """Display class of a stage text, by substring and in this order of precedence."""
    text = F.lower(F.coalesce(_col(stage), F.lit("")))
    return (
        F.when(F.contains(text, F.lit("high")), F.lit("hot"))
        .when(
            F.contains(text, F.lit("problem")) | F.contains(text, F.lit("trigger")), F.lit("warm")
        )
        .otherwise(F.lit("cool"))
    )


def is_high_intent(stage: Column | str) -> Column:
    return F.contains(F.lower(F.coalesce(_col(stage), F.lit(""))), F.lit("high"))


def stage_from_counts(
    explicit: Column, pain: Column, workaround: Column, switching: Column, timing: Column
) -> Column:
    """Strongest stage the bucket counts support."""
    return (
        F.when((explicit > 0) | (switching > 0), F.lit(HIGH_INTENT))
        .when((pain > 0) | (workaround > 0), F.lit(PROBLEM_AWARE))
        .when(timing > 0, F.lit(TRIGGER_PRESENT))
        .otherwise(F.lit(POTENTIAL_FIT))
    )
