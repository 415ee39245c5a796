"""Drafts for manual outreach. Nothing here sends anything."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.config import CHANNELS, DEFAULT_CHANNEL
from signalsieve.functions.texts import opener_problems, word_count
from signalsieve.operators.skew import salted_join

# Most words of a cited title in an opener.
TITLE_WORDS = 12
# How a bucket is put into words in an opener.
_PROBLEM = {
    "explicit_demand": "the search for a tool",
    "pain": "the problem described there",
    "workaround": "the manual workaround described there",
    "switching": "the move away from the current tool",
    "timing": "the recent change announced there",
}


def channel_for(source_type: Column, channels: Mapping[str, str] = CHANNELS) -> Column:
    chain = F.lit(None).cast("string")
    for kind, channel in channels.items():
        chain = F.when(source_type == kind, F.lit(channel)).otherwise(chain)
    return F.coalesce(chain, F.lit(DEFAULT_CHANNEL))


def recommend_channel(
    prospects: DataFrame, channels: Mapping[str, str] | None = None, policy: DataFrame | None = None
) -> DataFrame:
    """Adds ``suggested_channel``, the public channel that belongs to the best signal's source.

    ``policy`` (source_type, channel) replaces the built-in channels.
    """
    if policy is None:
        return prospects.withColumn(
            "suggested_channel", channel_for(F.col("source_type"), channels or CHANNELS)
        )
    table = policy.select("source_type", F.col("channel").alias("_channel"))
    return (
        salted_join(prospects, table, ["source_type"], how="left", spread_on=["entity_key"])
        .withColumn("suggested_channel", F.coalesce("_channel", F.lit(DEFAULT_CHANNEL)))
        .drop("_channel")
    )


def draft_openers(prospects: DataFrame, briefs: DataFrame) -> DataFrame:
    """Adds ``opener``: public context, exact problem, product in one sentence, one question.

    Built only from the cited source and the brief. Rows need source_title and best_bucket;
    briefs need product, promised_outcome and job_to_be_done.
    """
    problem: Column = F.lit("the need described there")
    for bucket, words in _PROBLEM.items():
        problem = F.when(F.col("best_bucket") == bucket, F.lit(words)).otherwise(problem)

    def plain(name: str) -> Column:
        # A cited text's question marks would add a second question.
        return F.trim(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"[?\s]+", " "))

    # A cited title keeps its first words: the opener has a limit.
    words = F.split(plain("source_title"), " ")
    title = F.when(F.size(words) <= TITLE_WORDS, plain("source_title")).otherwise(
        F.concat(F.array_join(F.slice(words, 1, TITLE_WORDS), " "), F.lit(" ..."))
    )

    facts = briefs.select("product_id", "product", "promised_outcome", "job_to_be_done")
    joined = salted_join(
        prospects.drop("product", "promised_outcome", "job_to_be_done"),
        facts,
        ["product_id"],
        how="left",
        spread_on=["entity_key"],
    )
    opener = F.concat_ws(
        " ",
        F.format_string('I read your public post "%s".', title),
        F.format_string("It touches %s, which is what we work on.", problem),
        F.format_string("%s helps to %s.", plain("product"), plain("promised_outcome")),
        F.format_string("How do you handle %s today?", plain("job_to_be_done")),
    )
    return joined.withColumn("opener", opener)


def lint_openers(drafts: DataFrame, text: str = "opener") -> DataFrame:
    """Adds ``n_words``, ``problems`` and ``passes`` for each draft."""
    return (
        drafts.withColumn("n_words", word_count(text))
        .withColumn("problems", opener_problems(text))
        .withColumn("passes", F.size("problems") == 0)
    )


def outreach_plan(shortlist: DataFrame) -> DataFrame:
    """Manual seven-day queue: the three best on day 1, the others spread over days 2 to 7."""
    return shortlist.withColumn(
        "day",
        F.when(F.col("rank") <= 3, F.lit(1)).otherwise(
            (F.lit(2) + F.pmod(F.col("rank") - 4, F.lit(6))).cast("int")
        ),
    ).withColumn("status", F.lit("draft"))
