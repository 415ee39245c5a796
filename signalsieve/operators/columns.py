"""Columns that later filters must not recompute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns as the output of a one-row generator.

    The optimizer moves a filter on a plain column below the projection and copies the column's
    expression into it, which would parse or classify every text twice. It does not move a
    filter on generated columns.
    """
    row = F.struct(*(value.alias(name) for name, value in columns.items()))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(row)))
