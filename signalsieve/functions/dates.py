"""Visible publication dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalsieve.config import NO_DATE
from signalsieve.functions.numbers import _col


def normalise_date(text: Column | str) -> Column:
    """DATE of a ``YYYY-MM-DD`` text, NULL for anything else or an impossible day."""
    trimmed = F.trim(_col(text))
    return F.when(trimmed.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), trimmed.try_cast("date"))


def date_label(day: Column | str) -> Column:
    """Text of a DATE, or the fixed label when there is none."""
    return F.coalesce(_col(day).cast("string"), F.lit(NO_DATE))
