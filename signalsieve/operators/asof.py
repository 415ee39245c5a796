"""The latest earlier event of a key: which trigger was current when a signal came."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def latest_within(
    rows: DataFrame, events: DataFrame, on: Sequence[str], time: str, event_time: str, seconds: int, slices: int = 4
) -> DataFrame:
    """``rows`` with ``event``, the latest of ``events`` with the same ``on`` at or before ``time`` and at most
    ``seconds`` older, as a struct of its other columns; NULL if there is none.

    No pairs are made: rows and events of a key lie in one order of time, in which each row takes the last
    event before it. Time is cut into slices, each ``seconds / slices`` long, and an event is told to the slice
    it lies in and the ``slices`` after it, so a key with a third of all rows is as many groups as
    it has slices. Of events at one time the greatest by its columns counts. A row without a key or time
    has no event. Every column of ``events`` but the keys must have an order.
    """
    width = max(seconds * SECOND // slices, 1)
    at, when = _micros(time), _micros(event_time)
    facts = F.struct(*(c for c in events.columns if c not in on))
    told = events.filter(when.isNotNull()).select(
        *on, when.alias("_at"), facts.alias("_event"), F.explode(F.sequence(F.lit(0), F.lit(slices))).alias("_ahead")
    )
    told = told.withColumn("_slice", F.floor(F.col("_at") / width) + F.col("_ahead")).drop("_ahead")
    asked = rows.select(*on, at.alias("_at"), F.floor(at / width).alias("_slice"), F.struct(*rows.columns).alias("_row"))
    both = told.withColumn("_side", F.lit(0)).unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    # An event of the row's own time comes before it.
    order = Window.partitionBy(*on, "_slice").orderBy("_at", "_side", "_event").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn(
        "_last", F.last(F.when(F.col("_side") == 0, F.struct("_at", "_event")), ignorenulls=True).over(order)
    )
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    near = known & (F.col("_at") - F.col("_last._at") <= seconds * SECOND)
    return last.filter("_side = 1").select("_row.*", F.when(near, F.col("_last._event")).alias("event"))


def current_triggers(
    signals: DataFrame, triggers: DataFrame, days: int, on: Sequence[str] = ("product_id",), time: str = "signal_time"
) -> DataFrame:
    """Signals with the trigger that was current when they came: ``trigger_id`` and ``trigger_age`` in seconds.

    ``triggers`` has the key columns, trigger_id and trigger_time. A trigger stays current for ``days``.
    """
    wanted = triggers.select(*on, "trigger_time", "trigger_id")
    found = latest_within(signals, wanted, on, time, "trigger_time", days * 86_400)
    age = (_micros(time) - F.unix_micros(F.col("event.trigger_time").cast("timestamp"))) / SECOND
    return found.select(*signals.columns, F.col("event.trigger_id").alias("trigger_id"), age.alias("trigger_age"))
