"""What may be used: source, contact-data, sensitivity, originality and disqualifier rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsieve.config import BLOCKED_SOURCE_TYPES, MAX_INLINE_PHRASES, Phrase
from signalsieve.functions.texts import contact_flags, has_any_phrase, redact_contacts
from signalsieve.functions.urls import url_host, url_key
from signalsieve.operators.matching import lexicon_frame, phrase_hits
from signalsieve.operators.skew import salted_join


def apply_source_policy(
    signals: DataFrame,
    blocked_types: Sequence[str] = BLOCKED_SOURCE_TYPES,
    blocked_hosts: DataFrame | None = None,
) -> DataFrame:
    """Drops signals of a blocked source type or from a host in ``blocked_hosts`` (host).

    The type list is a fixed handful and is tested in the scan. Hosts can be many, so they
    are an anti-join, salted because one host may publish most signals.
    """
    kept = signals.filter(
        F.col("source_type").isNull() | ~F.col("source_type").isin(list(blocked_types))
    )
    if blocked_hosts is None:
        return kept
    hosts = blocked_hosts.select(F.lower("host").alias("_host")).distinct()
    return salted_join(
        kept.withColumn("_host", url_host("source_url")),
        hosts,
        ["_host"],
        how="left_anti",
        spread_on=["signal_id"],
    ).drop("_host")


def redact(signals: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Masks contact data in ``columns`` and lists what was found in ``policy_flags``."""
    flags = F.array_distinct(F.flatten(F.array(*(
        F.coalesce(contact_flags(c), F.array().cast("array<string>")) for c in columns
    ))))
    marked = signals.withColumn("policy_flags", flags)
    return marked.withColumns({c: redact_contacts(c) for c in columns})


def exclude_sensitive(
    signals: DataFrame,
    terms: Sequence[str] = (),
    flagged: DataFrame | None = None,
    text: str = "text",
) -> DataFrame:
    """Drops signals whose ground is a sensitive attribute.

    ``terms`` is the caller's list of phrases, matched in the row or, if it is long, by a join;
    ``flagged`` is a table of signal_id values marked elsewhere, for instance by phrase_hits().
    """
    kept = signals
    if len(terms) > MAX_INLINE_PHRASES:
        lexicon = lexicon_frame(signals.sparkSession, [Phrase("sensitive", t) for t in terms])
        found = phrase_hits(signals, lexicon, text).select("signal_id").distinct()
        kept = kept.join(found, "signal_id", "left_anti")
    elif terms:
        kept = kept.filter(~has_any_phrase(text, terms))
    if flagged is not None:
        kept = kept.join(flagged.select("signal_id").distinct(), "signal_id", "left_anti")
    return kept


def require_original(signals: DataFrame, originals: DataFrame) -> DataFrame:
    """Keeps signals that are no search snippet, or whose page is among ``originals`` (source_url)."""
    read = originals.select(url_key("source_url").alias("_page")).filter("_page IS NOT NULL").distinct()
    own = F.coalesce(F.col("is_snippet"), F.lit(False)) == F.lit(False)
    # A signal that needs no original gets a page key of its own kind, so it joins nothing
    # and does not pile up on one NULL key.
    joined = salted_join(
        signals.withColumn("_page", F.when(~own, url_key("source_url"))),
        read.withColumn("_read", F.lit(True)),
        ["_page"],
        how="left",
        spread_on=["signal_id"],
    )
    return joined.filter(own | F.col("_read")).drop("_page", "_read")


def drop_reasons(
    signals: DataFrame,
    briefs: DataFrame,
    sensitive_terms: Sequence[str] = (),
    blocked_types: Sequence[str] = BLOCKED_SOURCE_TYPES,
    blocked_hosts: DataFrame | None = None,
    originals: DataFrame | None = None,
) -> DataFrame:
    """Adds ``reason``, why a signal is not used, or NULL: the first that holds of ``source_type``,
    ``sensitive``, ``host``, ``snippet`` (without a page in ``originals``), ``brief`` (no ready brief
    for its product), ``language`` (known and not the brief's) and ``scope`` (dated after it).

    ``briefs`` needs product_id, as_of and lang. The tables behind a reason are joined by the
    signal's own key, so nothing but the flags is added to a row.
    """
    marked = signals.withColumn("_type", F.coalesce(F.col("source_type").isin(list(blocked_types)), F.lit(False)))
    sensitive = F.lit(False)
    if len(sensitive_terms) > MAX_INLINE_PHRASES:
        lexicon = lexicon_frame(signals.sparkSession, [Phrase("sensitive", t) for t in sensitive_terms])
        found = phrase_hits(signals, lexicon).select("signal_id").distinct().withColumn("_sensitive", F.lit(True))
        marked = salted_join(marked, found, ["signal_id"], how="left")
        sensitive = F.coalesce("_sensitive", F.lit(False))
    elif sensitive_terms:
        sensitive = has_any_phrase("text", sensitive_terms)
    hosted = F.lit(False)
    if blocked_hosts is not None:
        hosts = blocked_hosts.select(F.lower("host").alias("_host")).distinct().withColumn("_hosted", F.lit(True))
        marked = salted_join(marked.withColumn("_host", url_host("source_url")), hosts, ["_host"], how="left")
        hosted = F.coalesce("_hosted", F.lit(False))
    snippet = F.lit(False)
    if originals is not None:
        pages = originals.select(url_key("source_url").alias("_page")).filter("_page IS NOT NULL").distinct()
        short = F.coalesce("is_snippet", F.lit(False))
        marked = salted_join(
            marked.withColumn("_page", F.when(short, url_key("source_url"))), pages.withColumn("_read", F.lit(True)), ["_page"], how="left"
        )
        snippet = short & F.col("_read").isNull()
    wanted = briefs.select("product_id", F.col("as_of").alias("_as_of"), F.col("lang").alias("_lang"), F.lit(True).alias("_ready"))
    marked = salted_join(marked, wanted, ["product_id"], how="left")
    reason = (
        F.when(F.col("_type"), "source_type")
        .when(sensitive, "sensitive")
        .when(hosted, "host")
        .when(snippet, "snippet")
        .when(F.col("_ready").isNull(), "brief")
        .when(F.col("lang") != F.col("_lang"), "language")
        .when(F.col("signal_date") > F.col("_as_of"), "scope")
    )
    return marked.withColumn("reason", reason).select(*signals.columns, "reason")


def disqualified_entities(evidence: DataFrame, keys: Sequence[str] = ("product_id", "entity_key")) -> DataFrame:
    """Entities with at least one signal that hit a disqualifier of their product."""
    return evidence.filter("disqualified").select(*keys).distinct()


def apply_disqualifiers(
    prospects: DataFrame, hits: DataFrame, keys: Sequence[str] = ("product_id", "entity_key")
) -> DataFrame:
    """Drops the prospects listed in ``hits``. Both sides have few rows per key."""
    return prospects.join(hits.select(*keys).distinct(), list(keys), "left_anti")
