"""Nested reports from the shortlist tables, and checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsieve.config import (
    DEFAULT_MODE,
    DIMENSION_LABELS,
    DOCUMENT_TITLE,
    MODES,
    NO_PROSPECT,
    PLAN_DEFAULTS,
    PROSPECT_DEFAULTS,
)
from signalsieve.functions.dates import date_label
from signalsieve.functions.numbers import clamp
from signalsieve.functions.urls import has_valid_url, safe_url


def prospect_cards(shortlist: DataFrame) -> DataFrame:
    """Report columns of each shortlisted prospect.

    Rows need the shortlist columns, the best signal's source columns, ``suggested_channel`` and
    ``opener``. All text is a template over cited facts. An opener that breaks a rule, by
    ``passes``, is left out.
    """
    opener = F.col("opener")
    if "passes" in shortlist.columns:
        opener = F.when(F.col("passes"), opener).otherwise("")
    ratings = F.struct(
        *(clamp(F.col(f"dimensions.{name}"), 5).alias(name) for name in DIMENSION_LABELS)
    )
    return shortlist.select(
        "product_id",
        "rank",
        F.lpad(F.col("rank").cast("string"), 2, "0").alias("label"),
        F.col("entity_name").alias("name"),
        F.coalesce("entity_type", F.lit(PROSPECT_DEFAULTS["type"])).alias("type"),
        "stage",
        "stage_class",
        "score",
        "band",
        F.concat_ws(": ", F.replace("best_bucket", F.lit("_"), F.lit(" ")), "source_title").alias("pain_signal"),
        F.format_string("%d signals, %d of them observed and linked.", "n_signals", "n_linked").alias("evidence"),
        F.format_string("Product fit is rated %d of 5.", ratings["product_fit"]).alias("why_fit"),
        F.concat(F.lit("Newest signal: "), date_label("newest"), F.lit(".")).alias("why_now"),
        "source_title",
        "source_url",
        "source_type",
        date_label("signal_date").alias("signal_date"),
        "suggested_channel",
        opener.alias("opener"),
        F.lit(PROSPECT_DEFAULTS["caution"]).alias("caution"),
        ratings.alias("dimensions"),
    )


def build_reports(
    briefs: DataFrame,
    cards: DataFrame,
    patterns: DataFrame,
    verdicts: DataFrame,
    limits: DataFrame,
) -> DataFrame:
    """One nested row per product: verdict, ICP, top prospect, shortlist, patterns, plan, limits.

    Only lists with a fixed bound are collected: a shortlist has at most the largest mode's
    number of rows per product and patterns at most one row per bucket. Products without
    prospects get a report too.
    """
    card = F.struct(*(F.col(c) for c in cards.columns if c != "product_id"))
    listed = cards.groupBy("product_id").agg(F.sort_array(F.collect_list(card)).alias("prospects"))
    pattern = F.struct(
        "rank",
        F.col("bucket").alias("title"),
        "count",
        F.format_string("Seen at %d prospects.", "count").alias("insight"),
        "samples",
    )
    repeated = patterns.groupBy("product_id").agg(F.sort_array(F.collect_list(pattern)).alias("patterns"))
    joined = (
        briefs.join(listed, "product_id", "left")
        .join(repeated, "product_id", "left")
        .join(verdicts, "product_id", "left")
        .join(limits.select("product_id", "limits"), "product_id", "left")
    )
    prospects = F.coalesce("prospects", F.array().cast(listed.schema["prospects"].dataType))
    top = F.get(prospects, F.lit(0))
    named = F.array_join(F.transform(F.slice(prospects, 1, 3), lambda p: p["name"]), ", ")
    first_step = F.when(F.size(prospects) > 0, F.concat(F.lit("Contact by hand: "), named, F.lit("."))).otherwise(
        F.lit(PLAN_DEFAULTS["first_step"])
    )
    return joined.select(
        "product_id",
        F.lit(DOCUMENT_TITLE).alias("title"),
        "product",
        safe_url("product_url").alias("product_url"),
        "target_customer",
        F.format_string("Public sources, language %s, last %d months", F.coalesce("lang", F.lit("any")), "scope_months").alias("search_scope"),
        F.col("as_of").cast("string").alias("generated_at"),
        F.coalesce("mode", F.lit(DEFAULT_MODE)).alias("mode"),
        F.coalesce("verdict_flag", F.lit("none")).alias("verdict"),
        F.struct("primary_user", "economic_buyer", "job_to_be_done", "adoption_trigger", "disqualifiers").alias("icp"),
        F.struct(
            F.coalesce(top["name"], F.lit(NO_PROSPECT)).alias("name"),
            F.coalesce(top["score"], F.lit(0)).alias("score"),
            F.coalesce(top["why_now"], F.lit("")).alias("why_now"),
        ).alias("top_prospect"),
        F.coalesce("n_prospects", F.lit(0).cast("bigint")).alias("n_prospects"),
        F.coalesce("n_high_intent", F.lit(0).cast("bigint")).alias("n_high_intent"),
        F.coalesce("average_score", F.lit(0)).alias("average_score"),
        prospects.alias("prospects"),
        F.coalesce("patterns", F.array().cast(repeated.schema["patterns"].dataType)).alias("patterns"),
        F.struct(
            F.lit(PLAN_DEFAULTS["angle"]).alias("angle"),
            first_step.alias("first_step"),
            F.lit(PLAN_DEFAULTS["follow_up"]).alias("follow_up"),
            F.lit(PLAN_DEFAULTS["success"]).alias("success"),
        ).alias("outreach_plan"),
        "limits",
    )


def report_json(reports: DataFrame) -> DataFrame:
    return reports.select("product_id", F.to_json(F.struct(*(c for c in reports.columns))).alias("report"))


def validate_reports(reports: DataFrame) -> DataFrame:
    """One row per product and check, computed inside the report row."""
    cap = F.coalesce(
        *(F.when(F.col("mode") == m, F.lit(n)) for m, n in MODES.items()), F.lit(MODES[DEFAULT_MODE])
    )
    count = F.size("prospects")

    def failing(test) -> object:
        return F.size(F.filter("prospects", lambda p: ~F.coalesce(test(p), F.lit(False))))

    sections = [
        F.when(F.col("verdict").isNull() | (F.col("verdict") == ""), F.lit("verdict")),
        F.when(F.col("top_prospect.name").isNull(), F.lit("top_prospect")),
        F.when(F.col("outreach_plan.angle") == "", F.lit("outreach_plan")),
        F.when(F.size("limits") == 0, F.lit("limits")),
    ]
    checks = {
        "within_mode_cap": F.greatest(F.lit(0), count - cap),
        "source_urls_valid": failing(lambda p: has_valid_url(p["source_url"])),
        "scores_in_range": failing(lambda p: p["score"].between(0, 100)),
        "product_url_valid": F.when(has_valid_url("product_url"), 0).otherwise(1),
        "signals_present": failing(lambda p: F.length(p["pain_signal"]) > 0),
        "openers_present": failing(lambda p: F.length(p["opener"]) > 0),
        "sections_present": F.size(F.array_compact(F.array(*sections))),
    }
    rows = F.array(
        *(
            F.struct(F.lit(name).alias("check"), failures.cast("int").alias("n_failed"))
            for name, failures in checks.items()
        )
    )
    return reports.select("product_id", count.alias("n_prospects"), F.inline(rows)).withColumn(
        "passed", F.col("n_failed") == 0
    )
