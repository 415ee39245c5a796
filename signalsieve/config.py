"""Every constant and threshold the operators use, in one place."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple


class Phrase(NamedTuple):
    """One lexicon row. ``lang`` None means the phrase applies to every language."""

    bucket: str
    phrase: str
    lang: str | None = None


# --- Fixed values: names, words, weights, limits and default texts that results depend on ---

BUCKETS = ("explicit_demand", "pain", "workaround", "switching", "timing")

SEED_PHRASES = {
    "explicit_demand": ["looking for", "recommend a tool", "alternative to", "does anything exist"],
    "pain": ["takes hours", "manual", "frustrating", "hate", "difficult", "keeps breaking"],
    "workaround": [
        "spreadsheets",
        "copy-paste",
        "virtual assistants",
        "scripts",
        "templates",
        "repeated manual steps",
    ],
    "switching": [
        "cancellation",
        "migration",
        "missing feature",
        "pricing complaint",
        "competitor frustration",
    ],
    "timing": [
        "public launch",
        "hiring",
        "expansion",
        "new workflow",
        "regulation",
        "integration",
        "process change",
    ],
}

DIMENSION_LABELS = {
    "pain_strength": "Pain strength",
    "product_fit": "Product fit",
    "timing": "Timing",
    "reachability": "Reachability",
    "evidence_quality": "Evidence quality",
}

# Percent of the 0-100 score per dimension; each dimension is rated 0-5.
DIMENSION_WEIGHTS = {
    "pain_strength": 25,
    "product_fit": 25,
    "timing": 20,
    "reachability": 15,
    "evidence_quality": 15,
}

# Lowest rounded score of each band, best first.
BAND_FLOORS = (("strong", 80), ("promising", 65), ("plausible", 50))
BAND_BELOW = "excluded"
PRIMARY_FLOOR = 50

HIGH_INTENT = "High intent"
PROBLEM_AWARE = "Problem aware"
TRIGGER_PRESENT = "Trigger present"
POTENTIAL_FIT = "Potential fit"

# Most prospects shown per mode.
MODES = {
    "quick": 5,
    "standard": 10,
    "deep": 20,
    "design-partners": 10,
    "b2b": 10,
    "community": 10,
}
DEFAULT_MODE = "standard"
LARGEST_SHORTLIST = max(MODES.values())

OPENER_WORD_LIMIT = 90
PATTERN_COUNT_LIMIT = 999

NO_DATE = "date unavailable"
NO_PROSPECT = "No qualified prospect"
DEFAULT_LIMIT = (
    "These are potential customers inferred from public signals, not confirmed buyers."
)

# Text for a field an imported prospect does not have at all.
PROSPECT_DEFAULTS = {
    "type": "Public prospect",
    "stage": "Potential fit",
    "caution": "Confirm current relevance before outreach.",
    "source_type": "Public source",
    "signal_date": "Date unavailable",
    "source_title": "Open original source",
    "pain_signal": "",
    "evidence": "",
    "why_fit": "",
    "why_now": "",
    "suggested_channel": "",
    "opener": "",
}
PATTERN_DEFAULTS = {"title": "Repeated signal", "insight": ""}
DOCUMENT_DEFAULTS = {
    "product": "Not specified",
    "target_customer": "Not specified",
    "search_scope": "Not specified",
    "generated_at": "",
    "verdict": "No verdict supplied.",
}
PLAN_DEFAULTS = {
    "angle": "Validate the pain before pitching the product.",
    "first_step": "",
    "follow_up": "",
    "success": "",
}

BLOCKED_SOURCE_TYPES = (
    "private_group",
    "gated_community",
    "data_broker",
    "scraped_contact_database",
    "access_prohibited",
)

# Facts a brief must state before leads are collected.
BRIEF_FIELDS = (
    "product",
    "promised_outcome",
    "primary_user",
    "economic_buyer",
    "job_to_be_done",
    "current_alternative",
    "adoption_trigger",
    "disqualifiers",
)

# --- End of fixed values ---

DOCUMENT_TITLE = "Early customer report"

SEED_LEXICON = [
    Phrase(bucket, phrase, "en") for bucket, phrases in SEED_PHRASES.items() for phrase in phrases
]

# A lexicon list up to this length is matched inside each row; a longer one, or a
# DataFrame of any length, is matched by an equi-join on words, with the same results.
MAX_INLINE_PHRASES = 64

DISCUSSION_SOURCES = ("forum", "social_post", "issue_or_feature_request")
COMPANY_TYPES = ("company", "decision_role")

# Public channel that belongs to a source type; anything else gets DEFAULT_CHANNEL.
CHANNELS = {
    "forum": "Reply in the public thread",
    "social_post": "Reply to the public post",
    "product_review": "Respond through the public review page",
    "issue_or_feature_request": "Comment on the public issue",
    "company_page": "Use the contact form on the company page",
    "tool_request_or_directory": "Answer the public tool request",
}
DEFAULT_CHANNEL = "Reply where the signal was published"


@dataclass(frozen=True)
class ScoringConfig:
    """Thresholds that turn evidence counts into the five 0-5 ratings.

    The inputs to each rating are given by the method; these step sizes are ours.
    """

    pain_per_hit: float = 1.5
    fit_source: str = "icp"  # "icp": distinct ICP terms hit; "buckets": distinct buckets
    fit_base: float = 0.0
    fit_per_term: float = 1.0
    # (oldest age in days, rating), youngest first; older or undated gets the last two.
    timing_steps: tuple[tuple[int, int], ...] = ((30, 5), (90, 4), (180, 3))
    timing_older: int = 2
    timing_undated: int = 1
    trigger_bonus: int = 1
    trigger_days: int = 90  # a trigger up to this old is a current one
    reach_per_channel: float = 2.0
    reliability_weight: float = 0.6
    evidence_per_signal: float = 0.5
    evidence_base: float = 0.0
    default_reliability: int = 50  # percent, for a source type without a policy row
