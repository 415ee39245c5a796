"""Clamping of score-like values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal or infinite literal, with blanks around it.
_NUMBER = (
    r"(?i)^[\s\p{Z}]*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?)[\s\p{Z}]*$"
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it.

    A column that later steps filter on is copied into the filter by the optimizer, with every
    mention of a costly part computed anew. Bound as a lambda variable it is computed once.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bounded(value: Column | str, maximum: float) -> Column:
    """DOUBLE within [0, maximum]; NULL and NaN give 0.

    NaN is replaced first because it orders above every number in Spark.
    """
    if isinstance(value, str):
        return F.expr(
            f"greatest(0D, least({float(maximum)}D, coalesce(nanvl(cast({value} AS DOUBLE), 0D), 0D)))"
        )
    number = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(float(maximum)), number))


def clamp(value: Column | str, maximum: int = 100) -> Column:
    """Half-even rounded INT in [0, maximum]; NULL and NaN give 0."""
    return F.bround(bounded(value, maximum), 0).cast("int")


def parse_number(text: Column | str) -> Column:
    """DOUBLE of a plain decimal or infinite literal, else NULL (``1d`` or ``0x1A`` give NULL)."""
    raw = _col(text)
    return F.when(raw.rlike(_NUMBER), F.regexp_replace(raw, r"[\s\p{Z}]+", "").try_cast("double"))


def clamp_text(text: Column | str, maximum: int = 100) -> Column:
    """:func:`clamp` for a value that arrives as text."""
    return clamp(parse_number(text), maximum)
