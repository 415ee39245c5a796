"""The registered queries as plain SQL, to check results with another engine."""

from __future__ import annotations

from signalsieve.config import BUCKETS, DEFAULT_LIMIT, DIMENSION_LABELS
from signalsieve.functions.texts import ADDRESS, EMAIL, PHONE
from signalsieve.plans.bindings import LANGUAGE_LEXICON, SENSITIVE_STAND_IN, STAND_IN_LEXICON, SYLLABLES

_ORACLES: dict[str, str] = {}


def _add(name: str, sql: str, *ctes: str) -> None:
    _ORACLES[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)


# --- Orders as signals ---

_SOURCE = "CASE o_orderstatus WHEN 'F' THEN 'forum' WHEN 'O' THEN 'company_page' ELSE 'social_post' END"
_BUCKET = (
    "CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'explicit_demand' WHEN '2' THEN 'pain' "
    "WHEN '3' THEN 'workaround' WHEN '4' THEN 'timing' END"
)


def _order_rows(name: str) -> str:
    return f"""{name} AS (
  SELECT o_orderkey AS signal_id, o_custkey AS entity_key, {_SOURCE} AS source_type,
         CASE o_orderstatus WHEN 'F' THEN 60 WHEN 'O' THEN 90 ELSE 40 END AS reliability,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS signal_date, {_BUCKET} AS bucket,
         o_orderstatus = 'P' OR o_orderdate < TIMESTAMP '2000-08-01' AS stale, o_orderkey % 7 <> 0 AS linked,
         CASE WHEN o_orderkey % 7 = 0 THEN 'ftp' ELSE 'https' END || '://orders.example/' || o_orderkey AS source_url,
         'Order ' || o_orderkey AS source_title
  FROM orders)"""


_ORDERS = _order_rows("ev")
_CUSTOMERS = """cust AS (
  SELECT c_custkey AS entity_key, c_mktsegment AS product_id, c_name AS entity_name,
         c_nationkey < 12 AS is_company, c_acctbal < 0 AS is_disqualified
  FROM customer)"""
_PRODUCTS = "products AS (SELECT DISTINCT c_mktsegment AS product_id FROM customer)"


def _profile(source: str, keys: str) -> str:
    per_bucket = ", ".join(f"count(*) FILTER (bucket = '{b}') AS n_{b}" for b in BUCKETS)
    return f"""profile AS (
  SELECT {keys}, count(*) AS n_signals, {per_bucket}, count(bucket) AS n_observed,
         count(bucket) FILTER (linked) AS n_linked, count(*) FILTER (signal_date IS NULL) AS n_undated,
         count(*) FILTER (stale) AS n_stale, count(DISTINCT CASE WHEN linked THEN source_type END) AS n_channels, max(signal_date) AS newest,
         max(CASE WHEN bucket = 'timing' THEN signal_date END) AS newest_trigger,
         sum(reliability) AS reliability_sum, count(reliability) AS reliability_n,
         count(*) FILTER (source_type IN ('forum','social_post','issue_or_feature_request')) AS n_discussion
  FROM {source} GROUP BY {keys})"""


_DISTINCT_BUCKETS = " + ".join(f"(n_{b} > 0)::INT" for b in BUCKETS)


def _age(day: str, as_of: str) -> str:
    return f"(DATE '{as_of}' - {day})"


def _rated(
    as_of: str = "2001-08-01",
    pain: float = 1.5,
    fit_base: float = 0.0,
    bonus: int = 1,
    reliability_weight: float = 0.6,
    per_signal: float = 0.5,
    base: float = 0.0,
) -> str:
    """Ratings, score, band and stage over ``profile``."""
    newest = _age("newest", as_of)
    return f"""rated AS (
  SELECT *, least(5.0::DOUBLE, (n_pain + n_workaround + n_switching) * {pain}::DOUBLE) AS pain_strength,
    least(5.0::DOUBLE, ({_DISTINCT_BUCKETS}) * 1.0::DOUBLE + {fit_base}::DOUBLE) AS product_fit,
    least(5.0::DOUBLE, (CASE WHEN newest IS NULL THEN 1 WHEN {newest} <= 30 THEN 5 WHEN {newest} <= 90 THEN 4
       WHEN {newest} <= 180 THEN 3 ELSE 2 END
      + CASE WHEN {_age("newest_trigger", as_of)} <= 90 THEN {bonus} ELSE 0 END)::DOUBLE) AS timing,
    least(5.0::DOUBLE, n_channels * 2.0::DOUBLE) AS reachability,
    least(5.0::DOUBLE, ((coalesce(reliability_sum, 0)::BIGINT + (n_signals - reliability_n) * 50)::DOUBLE / n_signals)
      * ({reliability_weight}::DOUBLE / 20.0::DOUBLE) + n_signals * {per_signal}::DOUBLE + {base}::DOUBLE) AS evidence_quality
  FROM profile),
scored AS (
  SELECT *, CAST(round_even(least(100.0::DOUBLE, greatest(0.0::DOUBLE,
      pain_strength * 5.0::DOUBLE + product_fit * 5.0::DOUBLE + timing * 4.0::DOUBLE
      + reachability * 3.0::DOUBLE + evidence_quality * 3.0::DOUBLE)), 0) AS INTEGER) AS score,
    CASE WHEN n_explicit_demand > 0 OR n_switching > 0 THEN 'High intent'
         WHEN n_pain > 0 OR n_workaround > 0 THEN 'Problem aware'
         WHEN n_timing > 0 THEN 'Trigger present' ELSE 'Potential fit' END AS stage
  FROM rated),
banded AS (
  SELECT *, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 65 THEN 'promising'
                 WHEN score >= 50 THEN 'plausible' ELSE 'excluded' END AS band,
    CASE WHEN lower(stage) LIKE '%high%' THEN 'hot'
         WHEN lower(stage) LIKE '%problem%' OR lower(stage) LIKE '%trigger%' THEN 'warm' ELSE 'cool' END AS stage_class
  FROM scored)"""


_ORDER_RATED = _rated(pain=2.0, fit_base=1.0, bonus=0, reliability_weight=0.0, per_signal=1.0, base=1.0)
_PROSPECTS = "pros AS (SELECT * FROM banded JOIN cust USING (entity_key))"
_ORDER_PROSPECTS = (_ORDERS, _CUSTOMERS, _profile("ev", "entity_key"), _ORDER_RATED, _PROSPECTS)
_GATE = "n_observed >= 1 AND n_linked >= 1 AND score >= 50 AND stage <> 'Potential fit'"
_GATE_ALL = _GATE + " AND NOT is_disqualified"
_TEN_BEST = f"""best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, timing DESC, entity_key) AS rank
    FROM pros WHERE {_GATE_ALL}) WHERE rank <= 10)"""

_add(
    "shortlist_by_product",
    f"""SELECT product_id, CAST(rank AS INTEGER) AS rank, entity_key, entity_name, score, band, stage FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, timing DESC, entity_key) AS rank
  FROM pros WHERE {_GATE_ALL}) WHERE rank <= 10""",
    *_ORDER_PROSPECTS,
)
_RATINGS = "product_id, entity_key, n_signals, pain_strength, product_fit, timing, reachability, evidence_quality, score, band, stage, stage_class"
_add("prospect_ratings", f"SELECT {_RATINGS} FROM pros", *_ORDER_PROSPECTS)
_add(
    "prospect_ratings_default",
    f"SELECT {_RATINGS} FROM pros",
    _ORDERS,
    _CUSTOMERS,
    _profile("ev", "entity_key"),
    _rated(),
    _PROSPECTS,
)
_add(
    "resolved_customers",
    """SELECT product_id, entity_key, count(*) AS n_signals, count(DISTINCT source_type) AS n_source_types,
  min(signal_id) AS first_signal_id FROM ev JOIN cust USING (entity_key) GROUP BY product_id, entity_key""",
    _ORDERS,
    _CUSTOMERS,
)
_SYLLABLES = "[" + ", ".join(f"'{x}'" for x in SYLLABLES) + "]"
# Every pair of profiles is looked at here, so the blocks of the Spark query must lose none.
_PROFILES = f"""named AS (
  SELECT c_custkey AS k, [list_aggregate([{_SYLLABLES}[CAST(x AS INT) + 1] FOR x IN string_split(d[i:i + 2], '')], 'string_agg', '') FOR i IN [1, 4, 7]] AS w
  FROM (SELECT *, lpad(CAST((c_custkey + 1) * 617920037 % 1000000000 AS VARCHAR), 9, '0') AS d FROM customer)
), spelled AS (
  SELECT k, array_to_string(w, '') AS compact, array_to_string(w, '_') AS handle,
         array_to_string([upper(x[1]) || x[2:] FOR x IN w], ' ') AS name FROM named
), profiles AS (
  SELECT k * 8 AS id, name, CASE WHEN k % 3 = 0 THEN compact || '.example' END AS site, NULL AS handle FROM spelled
  UNION ALL SELECT k * 8 + 1, name, NULL, handle FROM spelled WHERE k % 2 = 0
  UNION ALL SELECT k * 8 + 2, name[:k % 15 + 11] || name[k % 15 + 13:], NULL, NULL FROM spelled WHERE k % 3 = 0
  UNION ALL SELECT k * 8 + 3, NULL, NULL, handle FROM spelled WHERE k % 5 = 0
  UNION ALL SELECT k * 8 + 4, NULL, compact || '.example', NULL FROM spelled WHERE k % 6 = 0
), plain AS (
  SELECT id, replace(lower(name), ' ', '') AS name, array_to_string(list_sort(string_split(lower(name), ' ')), '') AS sorted, site, replace(handle, '_', '') AS handle,
         split_part(site, '.', 1) AS label
  FROM profiles
), pairs AS (
  SELECT x.id AS a, y.id AS b, 1 - least(levenshtein(x.name, y.name), levenshtein(x.sorted, y.sorted)) / greatest(length(x.name), length(y.name)) AS n,
         CAST(x.site = y.site AS INT) AS s, CAST(x.handle = y.handle AS INT) AS h,
         coalesce(x.name = y.handle, FALSE) OR coalesce(x.handle = y.name, FALSE) OR coalesce(x.name = y.label, FALSE)
         OR coalesce(x.label = y.name, FALSE) OR coalesce(x.handle = y.label, FALSE) OR coalesce(x.label = y.handle, FALSE) AS alias
  FROM plain x JOIN plain y ON x.id < y.id
), links AS (
  SELECT a, b FROM pairs
  WHERE (alias OR s = 1 OR h = 1 OR n = 1 OR n >= 1 - 1 / 26.0)
    AND (coalesce(0.5 * n, 0) + coalesce(0.2 * s, 0) + coalesce(0.3 * h, 0) + CASE WHEN alias THEN 0.4 ELSE 0 END)
      / (CASE WHEN n IS NULL THEN 0 ELSE 0.5 END + CASE WHEN s IS NULL THEN 0 ELSE 0.2 END + CASE WHEN h IS NULL THEN 0 ELSE 0.3 END
         + CASE WHEN alias THEN 0.4 ELSE 0 END) >= 0.65
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT id, id AS top FROM plain UNION SELECT b, top FROM reached JOIN ways ON reached.id = ways.a)"""
_add(
    "resolved_profiles",
    "SELECT id AS profile_id, min(top) AS entity_id FROM reached GROUP BY id",
    "RECURSIVE " + _PROFILES,
)
_add(
    "score_breakdown",
    "SELECT product_id, entity_key, position, dimension, label, rating, rating * 20 AS bar_percent FROM ("
    + " UNION ALL ".join(
        f"SELECT product_id, entity_key, {i} AS position, '{name}' AS dimension, '{label}' AS label, "
        f"CAST(round_even({name}, 0) AS INTEGER) AS rating FROM pros"
        for i, (name, label) in enumerate(DIMENSION_LABELS.items(), 1)
    )
    + ")",
    *_ORDER_PROSPECTS,
)


def _clamp(value: str, maximum: int) -> str:
    return f"CAST(round_even(least({maximum}.0::DOUBLE, greatest(0.0::DOUBLE, {value})), 0) AS INTEGER)"


_add(
    "clamped_prices",
    f"""SELECT o_orderkey, {_clamp("o_totalprice / 4000", 100)} AS score,
  {_clamp("o_totalprice / 90000 - 1", 5)} AS rating, {_clamp("o_totalprice / 400", 999)} AS pattern_count,
  {_clamp("o_totalprice / 4000", 100)} AS score_of_text, 0 AS score_of_words FROM orders""",
)
_add(
    "signal_dates",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS signal_date,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE 'date unavailable' END AS label
  FROM orders""",
)
_add(
    "stage_classes",
    "SELECT entity_key, stage_class, 'hot' AS class_of_text, band FROM pros",
    *_ORDER_PROSPECTS,
)
_add(
    "qualified_prospects",
    f"SELECT product_id, entity_key, score, stage FROM pros WHERE {_GATE_ALL}",
    *_ORDER_PROSPECTS,
)
_add(
    "rejected_prospects",
    f"""SELECT product_id, entity_key, concat_ws(',',
    CASE WHEN n_observed < 1 THEN 'no_signal' END, CASE WHEN n_linked < 1 THEN 'bad_url' END,
    CASE WHEN score < 50 THEN 'low_score' END, CASE WHEN stage = 'Potential fit' THEN 'potential_fit' END,
    CASE WHEN is_disqualified THEN 'disqualified' END) AS reasons
  FROM pros WHERE NOT ({_GATE_ALL})""",
    *_ORDER_PROSPECTS,
)
_add(
    "prospects_without_disqualified",
    "SELECT product_id, entity_key, score FROM pros WHERE NOT is_disqualified",
    *_ORDER_PROSPECTS,
)
_add(
    "ranked_prospects",
    """SELECT product_id, entity_key, score,
  row_number() OVER (PARTITION BY product_id ORDER BY score DESC, timing DESC, entity_key) AS rank FROM pros""",
    *_ORDER_PROSPECTS,
)


def _two_tests(first: str, second: str) -> str:
    return f"CASE WHEN {first} AND {second} THEN 0 WHEN {first} THEN 1 WHEN {second} THEN 2 ELSE 3 END"


_MODE = (
    "CASE product_id WHEN 'AUTOMOBILE' THEN 'quick' WHEN 'BUILDING' THEN 'deep' "
    "WHEN 'FURNITURE' THEN 'design-partners' WHEN 'HOUSEHOLD' THEN 'b2b' ELSE 'community' END"
)
_add(
    "shortlist_by_mode",
    """SELECT product_id, mode, CAST(priority AS INTEGER) AS priority, CAST(rank AS INTEGER) AS rank, entity_key, score FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY priority, score DESC, timing DESC, entity_key) AS rank
  FROM prioritised) WHERE rank <= CASE mode WHEN 'quick' THEN 5 WHEN 'deep' THEN 20 ELSE 10 END""",
    *_ORDER_PROSPECTS,
    f"moded AS (SELECT *, {_MODE} AS mode FROM pros WHERE {_GATE_ALL})",
    f"""prioritised AS (SELECT *, CASE mode
    WHEN 'design-partners' THEN {_two_tests("n_pain + n_workaround > 0", "NOT (n_explicit_demand + n_switching > 0)")}
    WHEN 'b2b' THEN {_two_tests("is_company", "n_timing > 0")}
    WHEN 'community' THEN {_two_tests("n_explicit_demand > 0", "n_discussion > 0")}
    ELSE 0 END AS priority FROM moded)""",
)
_add(
    "top_prospects",
    f"""SELECT product_id, coalesce(entity_name, 'No qualified prospect') AS top_name, coalesce(score, 0) AS top_score,
    coalesce(stage, '') AS top_text
  FROM products LEFT JOIN (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, entity_key) AS n FROM pros WHERE {_GATE_ALL})
    WHERE n = 1) USING (product_id)""",
    *_ORDER_PROSPECTS,
    _PRODUCTS,
)
_KPIS = """kpis AS (
  SELECT product_id, coalesce(n_prospects, 0) AS n_prospects, coalesce(n_high_intent, 0) AS n_high_intent,
    coalesce(average_score, 0) AS average_score, coalesce(best_reachability, 0) AS best_reachability
  FROM products LEFT JOIN (
    SELECT product_id, count(*) AS n_prospects, count(*) FILTER (lower(stage) LIKE '%high%') AS n_high_intent,
      CAST(round_even(sum(score)::DOUBLE / count(score), 0) AS INTEGER) AS average_score,
      max(reachability) AS best_reachability
    FROM {source} GROUP BY product_id) USING (product_id)),
verdicts AS (SELECT *, CASE WHEN n_prospects >= 3 AND n_high_intent >= 1 AND best_reachability >= 3 THEN 'reachable'
    WHEN n_prospects >= 1 THEN 'emerging' ELSE 'none' END AS verdict_flag FROM kpis)"""
_add(
    "product_verdicts",
    "SELECT * FROM verdicts",
    *_ORDER_PROSPECTS,
    _PRODUCTS,
    f"gated AS (SELECT * FROM pros WHERE {_GATE_ALL})",
    _KPIS.format(source="gated"),
)
_add(
    "band_stage_totals",
    """SELECT product_id, band, stage, count(*) AS n_prospects, CAST(grouping(band, stage) AS INTEGER) AS level
  FROM pros GROUP BY GROUPING SETS ((product_id, band, stage), (product_id, band), (product_id, stage), (product_id))""",
    *_ORDER_PROSPECTS,
)


def _limits(source: str) -> str:
    return f"""noted AS (
  SELECT product_id, coalesce(n_undated_prospects, 0) AS n_undated_prospects, coalesce(n_inferred_only, 0) AS n_inferred_only,
    coalesce(n_single_source, 0) AS n_single_source, coalesce(n_stale_only, 0) AS n_stale_only
  FROM products LEFT JOIN (
    SELECT product_id, count(*) FILTER (n_undated > 0) AS n_undated_prospects, count(*) FILTER (n_observed = 0) AS n_inferred_only,
      count(*) FILTER (n_channels <= 1) AS n_single_source, count(*) FILTER (n_stale = n_signals) AS n_stale_only
    FROM {source} GROUP BY product_id) USING (product_id)),
limited AS (SELECT *, CASE WHEN n_undated_prospects + n_inferred_only + n_single_source + n_stale_only = 0
    THEN '{DEFAULT_LIMIT}' ELSE concat_ws(' | ',
    CASE WHEN n_undated_prospects > 0 THEN n_undated_prospects || ' prospects have a signal without a visible date.' END,
    CASE WHEN n_inferred_only > 0 THEN n_inferred_only || ' prospects rest on inference alone.' END,
    CASE WHEN n_single_source > 0 THEN n_single_source || ' prospects rest on one kind of source.' END,
    CASE WHEN n_stale_only > 0 THEN n_stale_only || ' prospects have only stale evidence.' END) END AS limits
  FROM noted)"""


_add("report_limits", "SELECT * FROM limited", *_ORDER_PROSPECTS, _PRODUCTS, _limits("pros"))

# --- Evidence ---

_add(
    "signals_in_scope",
    """SELECT signal_id, product_id, signal_date, CAST(DATE '2001-08-01' - signal_date AS INTEGER) AS age_days, signal_date IS NULL AS stale
  FROM ev JOIN cust USING (entity_key)
  WHERE signal_date IS NULL OR signal_date <= DATE '2001-08-01' AND signal_date >= CASE product_id
    WHEN 'AUTOMOBILE' THEN DATE '2001-05-01' WHEN 'BUILDING' THEN DATE '1999-08-01' ELSE DATE '2000-08-01' END""",
    _ORDERS,
    _CUSTOMERS,
)
_add(
    "signal_freshness",
    "SELECT signal_id, CAST(DATE '2001-08-01' - signal_date AS INTEGER) AS age_days, stale FROM ev",
    _ORDERS,
)
_add(
    "observed_or_inferred",
    """SELECT signal_id, CASE WHEN bucket IS NOT NULL THEN 'observed' ELSE 'inferred' END AS evidence_kind,
  coalesce(bucket, '') AS buckets FROM ev""",
    _ORDERS,
)


def _coverage(source: str) -> str:
    counts = ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in BUCKETS)
    return f"""SELECT product_id, source_type, {counts}, count(*) AS n_signals, grouping(source_type) = 1 AS is_total
  FROM {source} GROUP BY GROUPING SETS ((product_id, source_type), (product_id))"""


_EVENTS = """evt AS (
  SELECT event_id AS signal_id, 'app' AS product_id, user_id AS entity_key, event_type AS source_type,
    CAST(ts AS DATE) AS signal_date, NULL::INTEGER AS reliability, TRUE AS linked, FALSE AS stale,
    CASE WHEN value >= 150 THEN CASE event_type WHEN 'signup' THEN 'explicit_demand' WHEN 'error' THEN 'pain'
      WHEN 'click' THEN 'workaround' WHEN 'purchase' THEN 'switching' WHEN 'view' THEN 'timing' END END AS bucket
  FROM events)"""
_ORDER_EVIDENCE = "evidence AS (SELECT * FROM ev JOIN cust USING (entity_key))"
_add("order_coverage", _coverage("evidence"), _ORDERS, _CUSTOMERS, _ORDER_EVIDENCE)
_add("event_coverage", _coverage("evt"), _EVENTS)
_add(
    "coverage_gaps",
    f"""SELECT product_id, count(DISTINCT source_type) AS n_source_types, concat_ws(',', {", ".join(
        f"CASE WHEN count(*) FILTER (bucket = '{b}') = 0 THEN '{b}' END" for b in BUCKETS
    )}) AS missing_buckets FROM evidence GROUP BY product_id""",
    _ORDERS,
    _CUSTOMERS,
    _ORDER_EVIDENCE,
)
_LEDGER = """ledger AS (
  SELECT best.product_id, best.rank, best.entity_key, best.entity_name, best.score, best.pain_strength,
    ev.signal_id, ev.source_title, ev.source_url, ev.source_type, ev.signal_date, ev.bucket, ev.stale, ev.linked
  FROM ev JOIN best USING (entity_key))"""
_add(
    "evidence_ledger",
    """SELECT product_id, CAST(rank AS INTEGER) AS rank, entity_name, signal_id, source_title,
    CASE WHEN linked THEN source_url ELSE '#' END AS source_url, source_type,
    coalesce(CAST(signal_date AS VARCHAR), 'date unavailable') AS date_label, CASE WHEN bucket IS NULL THEN 'inferred' ELSE 'observed' END AS evidence_kind,
    coalesce(bucket, '') AS buckets, score, pain_strength,
    CASE WHEN signal_date IS NULL THEN 'no date' WHEN stale THEN 'stale' END AS freshness_warning FROM ledger""",
    *_ORDER_PROSPECTS,
    _TEN_BEST,
    _LEDGER,
)


def _patterns(source: str) -> str:
    return f"""counted AS (SELECT product_id, bucket, count(DISTINCT entity_key) AS n FROM {source}
    WHERE bucket IS NOT NULL GROUP BY product_id, bucket HAVING count(DISTINCT entity_key) >= 2),
  sampled AS (SELECT product_id, bucket, string_agg(signal_id::VARCHAR, ',' ORDER BY signal_id) AS samples FROM (
      SELECT *, row_number() OVER (PARTITION BY product_id, bucket ORDER BY signal_id) AS k FROM {source}
      WHERE bucket IS NOT NULL) WHERE k <= 3 GROUP BY product_id, bucket),
  repeated AS (SELECT product_id, bucket, CAST(least(n, 999) AS INTEGER) AS "count", samples,
    CAST(row_number() OVER (PARTITION BY product_id ORDER BY n DESC, bucket) AS INTEGER) AS rank
    FROM counted JOIN sampled USING (product_id, bucket))"""


_add("order_patterns", "SELECT * FROM repeated", _ORDERS, _CUSTOMERS, _ORDER_EVIDENCE, _patterns("evidence"))
_add("event_patterns", "SELECT * FROM repeated", _EVENTS, _patterns("evt"))
_add(
    "event_stages",
    "SELECT product_id, entity_key, n_signals, n_observed, score, band, stage FROM banded",
    _EVENTS,
    _profile("evt", "product_id, entity_key"),
    _rated(as_of="2024-02-01"),
)

# --- Outreach and reports ---

_STRENGTH = "CASE bucket " + " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(BUCKETS)) + f" ELSE {len(BUCKETS)} END"
_SHOWN = f"""shown AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY bucket IS NOT NULL DESC, linked DESC, {_STRENGTH}, signal_date DESC NULLS LAST, signal_id) AS k
    FROM ledger) WHERE k = 1)"""
_CHANNEL = """CASE source_type WHEN 'forum' THEN 'Reply in the public thread'
    WHEN 'company_page' THEN 'Use the contact form on the company page' ELSE 'Reply to the public post' END"""
_PROBLEM = """CASE bucket WHEN 'explicit_demand' THEN 'the search for a tool' WHEN 'pain' THEN 'the problem described there'
    WHEN 'workaround' THEN 'the manual workaround described there' ELSE 'the recent change announced there' END"""
_DESK = "upper(substr(product_id, 1, 1)) || lower(substr(product_id, 2)) || ' Desk'"
_add(
    "outreach_drafts",
    f"""SELECT *, CAST(len(string_split(opener, ' ')) AS INTEGER) AS n_words, TRUE AS passes,
    CAST(CASE WHEN rank <= 3 THEN 1 ELSE 2 + (rank - 4) % 6 END AS INTEGER) AS day, 'draft' AS status FROM (
  SELECT product_id, CAST(rank AS INTEGER) AS rank, entity_key, source_title, bucket AS best_bucket, {_CHANNEL} AS suggested_channel,
    'I read your public post "' || source_title || '". It touches ' || {_PROBLEM} || ', which is what we work on. '
    || {_DESK} || ' helps to answer every order on time. How do you handle late orders today?' AS opener
  FROM shown)""",
    *_ORDER_PROSPECTS,
    _TEN_BEST,
    _LEDGER,
    _SHOWN,
)
_SPACE = r"[\s\p{Z}]+"
_WORDS = f"len(list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> ''))"
_HAS_CONTACT = f"(regexp_matches(text, '{EMAIL}') OR regexp_matches(text, '{PHONE}') OR regexp_matches(text, '{ADDRESS}'))"
_SENT = (
    r"regexp_matches(lower(text), '(message|email|e-mail|opener|dm) (was|has been|is) sent"
    r"|(i|we) (have |already )*(sent|messaged|emailed|contacted) (you|them|him|her)')"
)
_QUESTIONS = "length(text) - length(replace(text, '?', ''))"
_add(
    "opener_lint_turns",
    f"""SELECT *, problems = '' AS passes FROM (
  SELECT conv_id, turn, CAST({_WORDS} AS INTEGER) AS n_words, concat_ws(',',
    CASE WHEN {_WORDS} >= 90 THEN 'too_long' END, CASE WHEN {_HAS_CONTACT} THEN 'contact_data' END,
    CASE WHEN {_SENT} THEN 'claims_sent' END, CASE WHEN {_QUESTIONS} <> 1 THEN 'not_one_question' END) AS problems
  FROM conversations)""",
)
_REPORT_TABLES = (
    *_ORDER_PROSPECTS,
    _PRODUCTS,
    _TEN_BEST,
    _LEDGER,
    _SHOWN,
    _KPIS.format(source="best"),
    _ORDER_EVIDENCE,
    f"gated AS (SELECT * FROM pros WHERE {_GATE_ALL})",
    "told AS (SELECT * FROM evidence WHERE entity_key IN (SELECT entity_key FROM gated))",
    _patterns("told"),
    _limits("gated"),
)
_REPORT_ROWS = """SELECT product_id, verdict_flag AS verdict,
    first_value(best.entity_name) OVER (PARTITION BY product_id ORDER BY best.rank) AS top_name,
    n_prospects, n_high_intent, average_score,
    (SELECT CAST(count(*) AS INTEGER) FROM repeated r WHERE r.product_id = best.product_id) AS n_patterns,
    limits, lpad(best.rank::VARCHAR, 2, '0') AS position, best.entity_name AS name,
    CASE WHEN is_company THEN 'Company' ELSE 'Public prospect' END AS type, best.score,
    source_url, coalesce(CAST(signal_date AS VARCHAR), 'date unavailable') AS signal_date,
    n_signals || ' signals, ' || n_linked || ' of them observed and linked.' AS evidence,
    'Newest signal: ' || coalesce(CAST(newest AS VARCHAR), 'date unavailable') || '.' AS why_now,
    CAST(round_even(best.pain_strength, 0) AS INTEGER) AS pain_strength
  FROM best JOIN (SELECT entity_key, source_url, signal_date FROM shown) USING (entity_key)
  JOIN verdicts USING (product_id) JOIN limited USING (product_id)"""
_add("nested_reports", _REPORT_ROWS, *_REPORT_TABLES)
_add("written_reports", _REPORT_ROWS, *_REPORT_TABLES)
_CHECKS = ("within_mode_cap", "source_urls_valid", "scores_in_range", "product_url_valid", "signals_present", "openers_present", "sections_present")
_add(
    "report_checks",
    "SELECT product_id, CAST(n_prospects AS INTEGER) AS n_prospects, unnest(["
    + ", ".join(f"'{c}'" for c in _CHECKS)
    + ']) AS "check", 0 AS n_failed, TRUE AS passed FROM verdicts',
    *_REPORT_TABLES,
)
_add(
    "brief_gaps",
    """SELECT product_id, missing, missing = '' AS ready FROM (SELECT c_custkey AS product_id, concat_ws(',',
    CASE WHEN NOT c_acctbal > 0 THEN 'promised_outcome' END, CASE WHEN NOT c_acctbal < 8000 THEN 'primary_user' END,
    CASE WHEN NOT c_nationkey < 20 THEN 'adoption_trigger' END, CASE WHEN NOT c_acctbal > 500 THEN 'disqualifiers' END,
    CASE WHEN NOT c_nationkey > 3 THEN 'geography_or_language' END) AS missing FROM customer)""",
)

# --- Texts ---

_NORMAL = (
    r"regexp_replace(' ' || regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}\p{Z}\s_-]+', ' . ', 'g') || ' ', "
    r"'[\p{Z}\s_-]+', ' ', 'g')"
)
_DOCS = f"docs AS (SELECT doc_id AS signal_id, source, lang, {_NORMAL} AS words FROM documents)"


def _lexicon(phrases) -> str:
    rows = ", ".join(
        f"('{p.bucket}', '{p.phrase}', {'NULL' if p.lang is None else repr(p.lang)})" for p in phrases
    )
    return f"lex(bucket, phrase, plang) AS (VALUES {rows})"


_HITS = """hits AS (SELECT signal_id, lang, bucket, phrase FROM docs JOIN lex
    ON (plang IS NULL OR plang = lang) AND contains(words, ' ' || phrase || ' '))"""
_STAND_IN = (_DOCS, _lexicon(STAND_IN_LEXICON), _HITS)
_LANGUAGE = (_DOCS, _lexicon(LANGUAGE_LEXICON), _HITS)
_add("bucket_hits", "SELECT DISTINCT signal_id, bucket FROM hits", *_STAND_IN)
_add("bucket_hits_by_join", "SELECT DISTINCT signal_id, bucket FROM hits", *_STAND_IN)
_add("language_bucket_hits", "SELECT DISTINCT signal_id, lang, bucket FROM hits", *_LANGUAGE)
_add("language_phrase_hits", "SELECT signal_id, bucket, phrase FROM hits", *_LANGUAGE)
_ICP = """terms(icp_role, kind, phrase) AS (VALUES ('primary','positive','was'), ('primary','trigger','this'),
    ('primary','positive','una'), ('adjacent','positive','de la'), ('adjacent','positive','the'),
    ('adjacent','trigger','und'), ('primary','disqualifier','worthless'))"""
_ICP_HITS = "found AS (SELECT * FROM docs JOIN terms ON contains(words, ' ' || phrase || ' '))"
for _name in ("icp_matches", "icp_matches_by_join"):
    _add(
        _name,
        """SELECT signal_id, coalesce(fit_terms, '') AS fit_terms,
    CASE WHEN coalesce(p + a, 0) = 0 THEN NULL WHEN p >= a THEN 'primary' ELSE 'adjacent' END AS icp_role,
    coalesce(icp_trigger, FALSE) AS icp_trigger, coalesce(disqualified, FALSE) AS disqualified
  FROM docs LEFT JOIN (SELECT signal_id,
      string_agg(phrase, ',' ORDER BY phrase) FILTER (kind <> 'disqualifier') AS fit_terms,
      count(*) FILTER (kind <> 'disqualifier' AND icp_role = 'primary') AS p,
      count(*) FILTER (kind <> 'disqualifier' AND icp_role = 'adjacent') AS a,
      bool_or(kind = 'trigger') AS icp_trigger, bool_or(kind = 'disqualifier') AS disqualified
    FROM found GROUP BY signal_id) USING (signal_id)""",
        _DOCS,
        _ICP,
        _ICP_HITS,
    )
_add(
    "document_fit",
    """SELECT lang AS product_id, source AS entity_key, count(DISTINCT phrase) AS n_fit_terms,
    least(5.0::DOUBLE, count(DISTINCT phrase)::DOUBLE) AS product_fit
  FROM found WHERE kind <> 'disqualifier' GROUP BY lang, source""",
    _DOCS,
    _ICP,
    _ICP_HITS,
)
_add(
    "document_evidence_quality",
    """SELECT source AS entity_key, count(*) AS n_signals, CAST(sum(quality * 100) AS BIGINT) AS reliability_sum,
    count(quality) AS reliability_n, least(5.0::DOUBLE,
      ((coalesce(sum(quality * 100), 0)::BIGINT + (count(*) - count(quality)) * 50)::DOUBLE / count(*))
      * (0.6::DOUBLE / 20.0::DOUBLE) + count(*) * 0.01::DOUBLE) AS evidence_quality
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
_add(
    "documents_in_scope",
    """SELECT doc_id AS signal_id, source AS product_id, CASE WHEN doc_id % 10 <> 0 THEN lang END AS lang,
    NULL::INTEGER AS age_days, TRUE AS stale FROM documents
  WHERE doc_id % 10 = 0 OR lang = CASE WHEN length(source) = 5 THEN 'en' ELSE 'fr' END""",
)
_MASKED = (
    f"regexp_replace(regexp_replace(regexp_replace(text, '{EMAIL}', '[email]', 'g'), "
    f"'{PHONE}', '[phone]', 'g'), '{ADDRESS}', '[address]', 'g')"
)
_add(
    "redacted_contacts",
    f"""SELECT doc_id AS signal_id, md5({_MASKED}) AS masked_md5, concat_ws(',',
    CASE WHEN regexp_matches(text, '{EMAIL}') THEN 'email' END, CASE WHEN regexp_matches(text, '{PHONE}') THEN 'phone' END,
    CASE WHEN regexp_matches(text, '{ADDRESS}') THEN 'address' END) AS policy_flags FROM documents""",
)
_add(
    "non_sensitive_documents",
    "SELECT signal_id FROM docs WHERE "
    + " AND ".join(f"NOT contains(words, ' {t} ')" for t in SENSITIVE_STAND_IN)
    + " AND signal_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    _DOCS,
)
_FOLDED = r"folded AS (SELECT doc_id, trim(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g')) AS t FROM documents)"
_add("distinct_documents", "SELECT min(doc_id) AS signal_id, md5(t) AS folded_md5 FROM folded GROUP BY t", _FOLDED)
_add(
    "document_copies",
    """SELECT doc_id AS signal_id, first_id AS duplicate_of FROM (
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS first_id FROM folded) WHERE doc_id <> first_id""",
    _FOLDED,
)
_add(
    "near_document_classes",
    "SELECT doc_id AS signal_id, min(top) AS class_id FROM reached GROUP BY doc_id",
    "RECURSIVE " + _FOLDED,
    """firsts AS (SELECT t, min(doc_id) AS id FROM folded WHERE t IS NOT NULL AND t <> '' GROUP BY t),
split AS (SELECT id, string_split(t, ' ') AS w FROM firsts),
runs AS (SELECT DISTINCT id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT *, unnest(range(greatest(len(w) - 4, 1))) AS i FROM split)),
sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM runs x JOIN runs y ON x.s = y.s AND x.id < y.id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON a = p.id JOIN sizes q ON b = q.id WHERE 10 * shared.n >= 8 * (p.n + q.n - shared.n)
  UNION ALL SELECT f.id, d.doc_id FROM folded d JOIN firsts f USING (t) WHERE f.id < d.doc_id),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS top FROM documents UNION SELECT b, top FROM reached JOIN ways ON doc_id = a)""",
)

# --- Pages ---


def _host(url: str) -> str:
    return f"regexp_replace(regexp_extract(lower(trim({url})), '^https?://([^/?#]*)', 1), '^(www|m)\\.', '')"


def _page_key(url: str) -> str:
    rest = f"regexp_extract(trim({url}), '(?i)^https?://[^/?#]*([^#]*)', 1)"
    path = f"regexp_replace(regexp_extract({rest}, '^([^?]*)', 1), '/+$', '')"
    query = f"regexp_extract({rest}, '^[^?]*\\?(.*)$', 1)"
    kept = (
        f"regexp_replace(regexp_replace({query}, '(^|&)(utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '', 'g'), '^&+', '')"
    )
    return f"{_host(url)} || {path} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"


_add(
    "page_urls",
    f"""SELECT page_id, spelling, spelling < 2 AS is_valid, CASE WHEN spelling < 2 THEN trim(raw) ELSE '#' END AS safe_url,
    CASE WHEN spelling < 2 THEN {_host("raw")} END AS host, CASE WHEN spelling < 2 THEN {_page_key("raw")} END AS page_key
  FROM (SELECT page_id, 0 AS spelling, url AS raw FROM pages
    UNION ALL SELECT page_id, 1, '  ' || replace(url, 'http', 'HTTP') || ' ' FROM pages
    UNION ALL SELECT page_id, 2, replace(url, ':', '') FROM pages
    UNION ALL SELECT page_id, 3, regexp_replace(url, '^https?', 'ftp') FROM pages)""",
)
_add(
    "distinct_pages",
    f"""SELECT signal_id, source_url FROM (
    SELECT *, row_number() OVER (PARTITION BY {_page_key("source_url")} ORDER BY signal_id) AS k FROM (
      SELECT page_id AS signal_id, url AS source_url FROM pages UNION ALL
      SELECT page_id + 1000000000, regexp_replace(url, '^https?://(www\\.)?', 'https://www.') FROM pages)) WHERE k = 1
  UNION ALL SELECT signal_id, source_url FROM (
    SELECT page_id + 2000000000 AS signal_id, url AS source_url,
      row_number() OVER (PARTITION BY {_page_key("url")} ORDER BY page_id) AS k FROM pages) WHERE k = 1""",
)
_add(
    "page_hosts",
    f"""SELECT 'web' AS product_id, {_host("url")} AS entity_key, count(*) AS n_signals,
    count(DISTINCT regexp_extract(url, '^(https?)', 1)) AS n_source_types, min(page_id) AS first_signal_id
  FROM pages GROUP BY ALL""",
)
_add(
    "allowed_pages",
    f"""SELECT page_id AS signal_id, url AS source_url FROM pages
  WHERE NOT contains(url, '/de/') AND NOT regexp_matches({_host("url")}, 'pills|adult|casino')""",
)
_add(
    "dropped_hosts",
    f"""SELECT 'web' AS product_id, entity_key, CASE WHEN bool_and(fr) THEN 'policy'
    WHEN bool_and(fr OR is_copy) THEN 'duplicate' ELSE 'no_signal' END AS reasons
  FROM (SELECT {_host("url")} AS entity_key, contains(url, '/fr/') AS fr, contains(url, '/en/') AS en,
      page_id > min(page_id) OVER (PARTITION BY regexp_replace(lower(html), '{_SPACE}', ' ', 'g')) AS is_copy FROM pages)
  GROUP BY entity_key HAVING NOT bool_or(en)""",
)
_add(
    "original_pages",
    f"""SELECT page_id AS signal_id, contains(url, '//m.') AS is_snippet FROM pages
  WHERE NOT contains(url, '//m.') OR {_page_key("url")} IN (SELECT {_page_key("url")} FROM pages WHERE contains(url, '/en/'))""",
)
_add(
    "signal_corpus",
    f"""SELECT 'product_review:' || doc_id AS signal_id, 'product_review' AS source_type, source AS entity_key, lang,
    NULL::VARCHAR AS source_url, CAST(length(text) AS INTEGER) AS n_chars FROM documents
  UNION ALL SELECT 'company_page:' || page_id, 'company_page', {_host("url")}, NULL, url, CAST(length(html) AS INTEGER) FROM pages
  UNION ALL SELECT 'forum:' || conv_id || '-' || turn, 'forum', NULL, NULL, NULL, CAST(length(text) AS INTEGER) FROM conversations""",
)

# --- Report documents ---

_DIGIT = "substr(o_orderpriority, 1, 1)"
_IMPORTED = f"""listed AS (
  SELECT o_orderkey AS document_id, {_DIGIT} AS d, o_orderstatus = 'P' AS lone, o_custkey, o_totalprice,
    {_clamp("o_totalprice / 5000", 100)} AS buyer_score FROM orders WHERE {_DIGIT} IN ('1', '2', '3')),
items AS (
  SELECT document_id, CASE WHEN lone THEN 1 ELSE 2 END AS input_position, 'Buyer ' || o_custkey AS name,
    CASE d WHEN '1' THEN 'High intent' WHEN '2' THEN 'Problem aware' ELSE 'Trigger present' END AS stage,
    CASE d WHEN '1' THEN 'hot' ELSE 'warm' END AS stage_class, buyer_score AS score,
    CASE WHEN d = '3' THEN '#' ELSE 'https://orders.example/' || document_id END AS source_url,
    CASE WHEN d = '2' THEN '' ELSE 'recent' END AS why_now, '' AS pain_signal,
    CAST(d AS INTEGER) AS pain_strength, CAST(round_even(CAST(d AS DOUBLE) + 0.5, 0) AS INTEGER) AS product_fit,
    5 AS timing, 1 AS reachability, 0 AS evidence_quality FROM listed
  UNION ALL
  SELECT document_id, 1, 'Prospect 1', 'Potential fit', 'cool', CAST(d AS INTEGER) * 10, '#', '', 'late', 0, 0, 0, 0, 0
  FROM listed WHERE NOT lone)"""
_add(
    "quarantined_documents",
    f"""SELECT o_orderkey AS document_id, CASE WHEN {_DIGIT} = '4' THEN '[' || o_orderkey || ']'
    ELSE '{{"title":' || o_orderkey END AS body,
    CASE WHEN {_DIGIT} = '4' THEN 'not_an_object' ELSE 'not_json' END AS reason FROM orders WHERE {_DIGIT} IN ('4', '5')""",
)
_FIVE = ", ".join(DIMENSION_LABELS)
_add(
    "imported_prospects",
    f"""SELECT document_id, input_position, name, 'Public prospect' AS type, stage, stage_class, score, source_url, why_now,
    pain_signal, 'Confirm current relevance before outreach.' AS caution, 'Date unavailable' AS signal_date, {_FIVE} FROM items""",
    _IMPORTED,
)
_add(
    "imported_reports",
    f"""SELECT document_id, 'Order ' || document_id AS title, '' AS product, 'No verdict supplied.' AS verdict,
    CASE WHEN lone THEN 1 ELSE 2 END AS n_prospects, CAST(d = '1' AS INTEGER) AS n_high_intent,
    CASE WHEN lone THEN buyer_score ELSE CAST(round_even((buyer_score + CAST(d AS INTEGER) * 10)::DOUBLE / 2, 0) AS INTEGER) END AS average_score,
    CASE WHEN lone OR buyer_score > CAST(d AS INTEGER) * 10 THEN 'Buyer ' || o_custkey ELSE 'No qualified prospect' END AS top_name,
    CASE WHEN lone THEN buyer_score ELSE greatest(buyer_score, CAST(d AS INTEGER) * 10) END AS top_score,
    CASE WHEN NOT lone AND buyer_score <= CAST(d AS INTEGER) * 10 THEN 'late' WHEN d = '2' THEN '' ELSE 'recent' END AS top_text,
    CAST(least(document_id, 999) AS INTEGER) AS pattern_count, 'Validate the pain before pitching the product.' AS angle,
    CASE WHEN d = '1' THEN 'a | b' ELSE '{DEFAULT_LIMIT}' END AS limits FROM listed""",
    _IMPORTED,
)
_BAND = "CASE WHEN {0} >= 80 THEN 'strong' WHEN {0} >= 65 THEN 'promising' WHEN {0} >= 50 THEN 'plausible' ELSE 'excluded' END"
_add(
    "reconciled_scores",
    f"""SELECT document_id, input_position, score AS reported_score, c AS computed_score, c - score AS delta, c <> score AS mismatch,
    {_BAND.format("score")} AS reported_band, {_BAND.format("c")} AS computed_band,
    {_BAND.format("score")} <> {_BAND.format("c")} AS band_changed
  FROM (SELECT *, 5 * pain_strength + 5 * product_fit + 4 * timing + 3 * reachability + 3 * evidence_quality AS c FROM items)""",
    _IMPORTED,
)
_add(
    "round_trip_reports",
    f"SELECT document_id, input_position, name, stage, score, source_url, why_now, {_FIVE} FROM items",
    _IMPORTED,
)

# --- Originals, triggers, sketches ---

_add(
    "page_originals",
    """SELECT page, original, cyclic FROM (
  SELECT page, CASE WHEN cyclic THEN list_min(path[list_position(path, last):]) ELSE last END AS original, cyclic,
         row_number() OVER (PARTITION BY page ORDER BY len(path)) AS n
  FROM ended) WHERE n = 1""",
    f"""RECURSIVE keyed AS (SELECT page_id, {_page_key("url")} AS page, {_host("url")} || '/moved?x=1&y=2' AS moved FROM pages),
named AS (
  SELECT a.page, CASE WHEN a.page_id % 8 = 6 THEN a.moved ELSE t.page END AS target FROM keyed a LEFT JOIN keyed t
  ON t.page_id = CASE WHEN a.page_id % 8 IN (0, 1, 2, 4) THEN a.page_id + 1 WHEN a.page_id % 8 = 5 THEN a.page_id - 1 END)""",
    "pointers AS (SELECT page, min(target) AS target FROM named GROUP BY page)",
    "nodes AS (SELECT page FROM pointers UNION SELECT target FROM pointers WHERE target IS NOT NULL)",
    """walks AS (
  SELECT page, page AS last, [page] AS path, FALSE AS cyclic FROM nodes
  UNION ALL SELECT w.page, target, list_append(path, target), list_contains(path, target)
  FROM walks w JOIN pointers p ON w.last = p.page WHERE target IS NOT NULL AND target <> w.last AND NOT cyclic)""",
    """ended AS (SELECT w.* FROM walks w LEFT JOIN pointers p ON w.last = p.page WHERE cyclic OR target IS NULL OR target = w.last)""",
)
_add(
    "current_event_triggers",
    """SELECT event_id, user_id, CASE WHEN near THEN found END AS trigger_id, CASE WHEN near THEN round(age, 3) END AS trigger_age
FROM (SELECT e.event_id, e.user_id, t.event_id AS found, (epoch_us(e.ts) - epoch_us(t.ts)) / 1e6 AS age, epoch_us(e.ts) - epoch_us(t.ts) <= 7 * 86400000000 AS near
  FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) t
  ON e.user_id = t.user_id AND e.ts >= t.ts)""",
)
_add(
    "order_pattern_estimates",
    """SELECT product_id, bucket, count(*) AS n_hits, count(DISTINCT entity_key) AS n_exact, TRUE AS is_near
FROM ev JOIN cust USING (entity_key) WHERE bucket IS NOT NULL GROUP BY ALL""",
    _ORDERS,
    _CUSTOMERS,
)

# --- Stored tables and streams ---

_ORACLES["refreshed_ratings"] = _ORACLES["prospect_ratings"]
_add(
    "streamed_first_events",
    """SELECT first(signal_id ORDER BY ts, signal_id) AS signal_id, text, epoch_us(min(ts)) AS started,
  epoch_us(max(ts) + INTERVAL 24 HOURS) AS ended, count(*) AS n_copies
FROM numbered GROUP BY text, session HAVING max(ts) + INTERVAL 24 HOURS <= (SELECT max(ts) FROM texts) - INTERVAL 12 HOURS""",
    "texts AS (SELECT event_id AS signal_id, CAST(ts AS TIMESTAMP) AS ts, event_type || ' ' || user_id AS text FROM events)",
    """marked AS (SELECT *, coalesce(ts > lag(ts) OVER same + INTERVAL 24 HOURS, TRUE) AS opens FROM texts
  WINDOW same AS (PARTITION BY text ORDER BY ts, signal_id))""",
    """numbered AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY text ORDER BY ts, signal_id
  ROWS UNBOUNDED PRECEDING) AS session FROM marked)""",
)
_add(
    "arrived_reports",
    f"""SELECT CASE WHEN reason IS NULL THEN 'Order ' || o_orderkey END AS title,
  CASE reason WHEN 'not_an_object' THEN '[' || o_orderkey || ']' WHEN 'not_json' THEN '{{"title":' || o_orderkey END AS body, reason
FROM (SELECT *, CASE {_DIGIT} WHEN '4' THEN 'not_an_object' WHEN '5' THEN 'not_json' END AS reason FROM orders)""",
)
