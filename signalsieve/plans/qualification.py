"""Briefs and signals to evidence, prospects, shortlist and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsieve.config import SEED_LEXICON, Phrase, ScoringConfig
from signalsieve.functions.texts import name_key
from signalsieve.functions.urls import url_host
from signalsieve.operators.aggregates import limits, patterns, report_kpis, verdict
from signalsieve.operators.briefs import brief_readiness, in_scope
from signalsieve.operators.dedup import copies_of, dedup_signals
from signalsieve.operators.evidence import best_evidence, coverage, evidence_ledger, label_evidence
from signalsieve.operators.matching import classify, match_icp_by_join
from signalsieve.operators.outreach import draft_openers, lint_openers, outreach_plan, recommend_channel
from signalsieve.operators.policy import drop_reasons, redact
from signalsieve.operators.ranking import dropped_entities, primary_gate, rejections, shortlist
from signalsieve.operators.reporting import build_reports, prospect_cards
from signalsieve.operators.scoring import dimension_breakdown, score_prospects
from signalsieve.operators.skew import salted_join, stable


@dataclass(frozen=True)
class Qualification:
    """Everything one run yields; each field is a DataFrame."""

    evidence: DataFrame
    prospects: DataFrame
    shortlist: DataFrame
    rejected: DataFrame
    dropped: DataFrame
    ledger: DataFrame
    coverage: DataFrame
    breakdown: DataFrame
    patterns: DataFrame
    outreach: DataFrame
    reports: DataFrame


def with_entity_key(signals: DataFrame) -> DataFrame:
    """Signals with a resolved entity; a signal of nobody in particular is left out."""
    key = F.coalesce("entity_key", name_key("entity_name"), url_host("source_url"))
    return signals.withColumn("entity_key", key).filter(F.col("entity_key").isNotNull())


def ready_briefs(briefs: DataFrame) -> DataFrame:
    return brief_readiness(briefs).filter("ready").drop("missing", "ready")


def prepare_evidence(
    briefs: DataFrame,
    signals: DataFrame,
    icp_terms: DataFrame,
    phrases: Sequence[Phrase] = SEED_LEXICON,
    sensitive_terms: Sequence[str] = (),
    blocked_hosts: DataFrame | None = None,
    originals: DataFrame | None = None,
    reliability: DataFrame | None = None,
) -> DataFrame:
    """Allowed, scoped, redacted, classified and deduplicated signals that say something.

    Row-local steps come before the shuffles, so deduplication moves only what is left.
    """
    ready = ready_briefs(briefs)
    marked = drop_reasons(signals, ready, sensitive_terms, blocked_hosts=blocked_hosts, originals=originals)
    allowed = marked.filter("reason IS NULL").drop("reason")
    # An old request still counts: it is marked stale and rated low on timing.
    scoped = in_scope(with_entity_key(allowed), ready, keep_old=True)
    matched = label_evidence(match_icp_by_join(classify(scoped, phrases), icp_terms))
    telling = matched.filter(F.col("evidence_kind").isNotNull() | F.col("disqualified"))
    deduped = dedup_signals(telling, scope=["product_id"])
    evidence = redact(deduped, ["text", "source_title", "entity_name"])
    if reliability is not None:
        evidence = salted_join(
            evidence, reliability, ["source_type"], how="left", spread_on=["signal_id"]
        )
    return evidence


def qualify(
    briefs: DataFrame,
    signals: DataFrame,
    icp_terms: DataFrame,
    config: ScoringConfig = ScoringConfig(),
    materialise: Callable[[DataFrame], DataFrame] = stable,
    **evidence_options,
) -> Qualification:
    """Runs every step for all products at once.

    Evidence, prospects and shortlist feed many results, so each is written once as a Parquet table
    in the shared folder, of which every result reads only its columns; pass
    ``materialise=lambda df: df`` to keep the whole run one lazy plan.
    """
    evidence = materialise(prepare_evidence(briefs, signals, icp_terms, **evidence_options))
    keys = ["product_id", "entity_key"]
    prospects = materialise(score_prospects(evidence, config))
    best = materialise(shortlist(prospects, briefs))
    ledger = evidence_ledger(evidence, best)
    shown = best_evidence(ledger).select(
        *keys, "entity_name", "entity_type", "source_title", "source_url", "source_type", "signal_date", "best_bucket"
    )
    drafts = lint_openers(
        draft_openers(recommend_channel(best.join(shown, keys)), briefs)
    )
    policies = {k: v for k, v in evidence_options.items() if k in ("sensitive_terms", "blocked_hosts", "originals")}
    raw = drop_reasons(with_entity_key(signals), ready_briefs(briefs), **policies)
    # What repeats among prospects that qualify, not among those turned down.
    qualified = primary_gate(prospects).select(*keys)
    repeated = patterns(evidence.join(qualified, keys, "left_semi"))
    figures = verdict(report_kpis(best, briefs))
    return Qualification(
        evidence=evidence,
        prospects=prospects,
        shortlist=best,
        rejected=rejections(prospects),
        dropped=dropped_entities(
            raw.select("signal_id", *keys, "reason"), prospects, copies_of(raw.filter("reason IS NULL"), scope=["product_id"])
        ),
        ledger=ledger,
        coverage=coverage(evidence),
        breakdown=dimension_breakdown(prospects),
        patterns=repeated,
        outreach=outreach_plan(drafts),
        reports=build_reports(
            briefs, prospect_cards(drafts), repeated, figures, limits(primary_gate(prospects), briefs)
        ),
    )
