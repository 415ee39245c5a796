"""Copies of a signal on a stream, by event time.

Copies that follow each other within ``gap`` are one session of a text, and its earliest signal stays. Sessions are an
event-time aggregation, so the same plan runs on a table and on a stream; there a session is given out
once the watermark has passed its end, and its state is let go. A signal later than ``lateness`` behind the
newest is dropped, any other finds its session however the signals are cut into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalsieve.functions.texts import text_key


def first_of_sessions(
    signals: DataFrame,
    event_time: str,
    gap: str,
    lateness: str | None = None,
    text: str = "text",
    signal_id: str = "signal_id",
) -> DataFrame:
    """The earliest signal of each session of copies, with all its columns, session_start, session_end and n_copies.

    Ties of time are broken by id. A signal with a blank text is a session of its own. ``lateness`` is for streams;
    signals without an event time have no session and are left out.
    """
    columns = signals.columns
    timed = signals.filter(F.col(event_time).isNotNull())
    if lateness is not None:
        timed = timed.withWatermark(event_time, lateness)
    own = F.concat(F.lit("row "), F.col(signal_id).cast("string"))
    keyed = timed.withColumn("_key", F.coalesce(text_key(text), own))
    sessions = keyed.groupBy(F.session_window(event_time, gap).alias("_session"), "_key").agg(
        F.min_by(F.struct(*columns), F.struct(event_time, signal_id)).alias("_first"), F.count("*").alias("n_copies")
    )
    return sessions.select(
        "_first.*", F.col("_session.start").alias("session_start"), F.col("_session.end").alias("session_end"), "n_copies"
    )


def append_first_signals(first: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed sessions of all signals available now to a Parquet folder, each once.

    Sessions that are still open stay in the state under ``checkpoint`` for the next run. Copies are
    folded in each task before they are shuffled, so a text with a third of all signals is few rows.
    """
    first.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (
        first.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
