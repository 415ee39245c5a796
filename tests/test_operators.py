"""Operators against brute force and against hand-made expectations."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from signalsieve.config import BUCKETS, MAX_INLINE_PHRASES, SEED_LEXICON, Phrase
from signalsieve.operators import aggregates, briefs, dedup, evidence, matching, outreach, policy, ranking, scoring, skew
from signalsieve.plans.bindings import order_documents
from signalsieve.operators.skew import ranked_rows, salted_join, spread_small
from signalsieve.sources.signals import read_signals, union_signals


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def evidence_frame(spark, records):
    """(signal_id, product_id, entity_key, source_type, url, day, buckets) rows as evidence."""
    schema = "signal_id long, product_id string, entity_key string, source_type string, source_url string, signal_date date, buckets array<string>"
    return spark.createDataFrame(records, schema).withColumn("as_of", F.lit(dt.date(2024, 6, 30)))


# --- Skew ---


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    dimension = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    salted = salted_join(facts, dimension, ["k"], how, spread_on=["id"])
    plain = facts.join(dimension, "k", how)
    columns = sorted(plain.columns)
    assert rows(salted, *columns) == rows(plain, *columns)


def test_heavy_groups_are_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVIEST", 2)
    keys = ["a" if i % 3 == 0 else f"k{i % 7}" if i % 2 else f"only{i}" for i in range(900)]
    facts = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    groups = facts.groupBy("k").agg(F.min("i").alias("first"), F.count("*").alias("n")).filter("n > 1")
    found = rows(skew.heavy_first_join(facts, groups, "k", "first", "n", "i"), "i", "first")
    firsts = {k: (keys.index(k) if keys.count(k) > 1 else None) for k in set(keys)}
    assert found == [(i, firsts[k]) for i, k in enumerate(keys)]


def test_salted_join_refuses_joins_that_keep_the_right_side(spark):
    with pytest.raises(ValueError):
        salted_join(spark.range(1), spark.range(1), ["id"], "full", spread_on=["id"])


def test_ranks_of_a_hot_group_are_exact(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(9)}", rng.randrange(5), i) for i in range(4000)]
    df = spark.createDataFrame(data, "g string, score int, i int")
    ranked = ranked_rows(df, ["g"], [F.col("score").desc(), F.col("i").asc()], partitions=7)
    expected = []
    for group in {g for g, _, _ in data}:
        members = sorted(((s, i) for g, s, i in data if g == group), key=lambda m: (-m[0], m[1]))
        expected += [(group, i, n) for n, (_, i) in enumerate(members, 1)]
    assert rows(ranked, "g", "i", "rank") == sorted(expected)


# --- Deduplication ---


def test_dedup_keeps_the_first_of_every_text_and_page(spark):
    data = [
        (1, "Same  Text", "https://a.com/1"),
        (2, "same text", "https://b.com/2"),
        (3, "other", "https://www.a.com/1/"),
        (4, "  ", None),
        (5, None, None),
        (6, "third", "https://b.com/2#x"),
        (7, "fourth", "not a url"),
        (8, "fifth", "not a url"),
    ]
    df = spark.createDataFrame(data, "signal_id int, text string, source_url string")
    # 2 copies the text of 1; 3 is the page of 1; 6 stays, as 2 with its page is gone.
    assert [r[0] for r in rows(dedup.dedup_signals(df), "signal_id")] == [1, 4, 5, 6, 7, 8]
    assert rows(dedup.copies_of(df), "signal_id", "duplicate_of") == [(2, 1)]


def test_dedup_of_a_hot_text_and_of_repeated_input(spark):
    data = [(i, "boilerplate" if i % 3 else f"text {i % 600}") for i in range(3000)]
    df = spark.createDataFrame(data, "signal_id int, text string")
    first = {}
    for i, text in data:
        first.setdefault(text, i)
    kept = dedup.dedup_signals(df)
    assert [r[0] for r in rows(kept, "signal_id")] == sorted(first.values())
    assert rows(dedup.dedup_signals(df.union(df)), "signal_id") == rows(kept, "signal_id")
    assert rows(dedup.copies_of(df), "signal_id", "duplicate_of") == sorted(
        (i, first[text]) for i, text in data if first[text] != i
    )


def test_several_people_on_one_page_all_stay(spark):
    page = "https://forum.example/t/1"
    df = spark.createDataFrame(
        [(1, "ann", "one", page), (2, "bob", "two", page), (3, "cy", "three", page), (4, "ann", "four", page + "/")],
        "signal_id int, entity_key string, text string, source_url string",
    )
    assert rows(dedup.dedup_signals(df), "signal_id") == [(1,), (2,), (3,)]


def test_scope_keeps_products_apart(spark):
    df = spark.createDataFrame([(1, "p", "t"), (2, "q", "t"), (3, "q", "T")], "signal_id int, product_id string, text string")
    assert rows(dedup.dedup_signals(df, scope=["product_id"]), "signal_id") == [(1,), (2,)]


# --- Matching ---

PLANTED = [
    (1, "We are looking for an alternative to Acme.", "en"),
    (2, "Billing takes hours and the export keeps breaking!", "en"),
    (3, "We copy-paste from spreadsheets; they hired virtual assistants.", "en"),
    (4, "Pricing complaint after the migration", "en"),
    (5, "Hiring for our public launch", "en"),
    (6, "Whatever, a manually chateau of hatefulness", "en"),
    (7, "hate", "de"),
    (8, "", "en"),
    (9, None, "en"),
]
EXPECTED = {
    1: {"explicit_demand"},
    2: {"pain"},
    3: {"workaround"},
    4: {"switching"},
    5: {"timing"},
}


def test_seed_lexicon_on_planted_texts(spark):
    df = spark.createDataFrame(PLANTED, "signal_id int, text string, lang string")
    inline = matching.classify(df, SEED_LEXICON)
    found = {r.signal_id: set(r.buckets) for r in inline.collect()}
    assert found == {i: EXPECTED.get(i, set()) for i, _, _ in PLANTED}
    joined = matching.classify_with_lexicon(df, matching.lexicon_frame(spark, SEED_LEXICON))
    assert {r.signal_id: set(r.buckets) for r in joined.collect()} == found


def test_both_matchers_agree_on_random_texts(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta", "été", "x1"]
    gaps = [" ", "  ", "-", ". ", ", ", "\n", "_"]
    texts = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(25)))
        texts.append((i, text, rng.choice(["en", "fr"])))
    phrases = [Phrase(rng.choice(BUCKETS), " ".join(rng.choice(words).lower() for _ in range(rng.randrange(1, 4))), rng.choice([None, "en", "fr"])) for _ in range(30)]
    df = spark.createDataFrame(texts, "signal_id int, text string, lang string")
    inline = {r.signal_id: set(r.buckets) for r in matching.classify(df, phrases).collect()}
    joined = matching.classify_with_lexicon(df, matching.lexicon_frame(spark, phrases))
    assert {r.signal_id: set(r.buckets) for r in joined.collect()} == inline
    assert any(inline.values())


def test_long_lexicons_and_long_phrases_are_not_cut(spark):
    many = [Phrase("pain", f"word{i}") for i in range(MAX_INLINE_PHRASES + 1)]
    df = spark.createDataFrame([(1, "word64")], "signal_id int, text string")
    assert rows(matching.classify(df, many), "buckets") == [(["pain"],)]
    assert rows(matching.phrase_hits(df, matching.lexicon_frame(spark, many)), "phrase") == [("word64",)]
    nine = "one two three four five six seven eight nine"
    texts = spark.createDataFrame([(1, f"And {nine}."), (2, nine.replace("nine", "ten"))], "signal_id int, text string")
    assert rows(matching.phrase_hits(texts, matching.lexicon_frame(spark, [Phrase("pain", nine)])), "signal_id") == [(1,)]
    terms = [f"word{i}" for i in range(MAX_INLINE_PHRASES + 1)]
    assert rows(policy.exclude_sensitive(df.union(texts.filter("signal_id = 2")), terms), "signal_id") == [(2,)]


def test_one_signal_under_two_products(spark):
    terms = spark.createDataFrame(
        [("a", "primary", "positive", "gym owner"), ("b", "primary", "disqualifier", "gym owner")],
        "product_id string, icp_role string, kind string, phrase string",
    )
    df = spark.createDataFrame([(1, "a", "A gym owner."), (1, "b", "A gym owner.")], "signal_id int, product_id string, text string")
    for match in (matching.match_icp, matching.match_icp_by_join):
        assert rows(match(df, terms), "product_id", "fit_terms", "disqualified") == [("a", ["gym owner"], False), ("b", [], True)]


def test_a_products_own_trigger_counts_as_timing(spark):
    day = dt.date(2024, 6, 1)
    df = evidence_frame(spark, [(1, "p", "e", "forum", "https://a.example/1", day, []), (2, "p", "f", "forum", "https://a.example/2", day, [])])
    marked = df.withColumn("icp_trigger", F.col("signal_id") == 1)
    found = {r.entity_key: (r.n_timing, r.newest_trigger) for r in scoring.entity_profile(marked).collect()}
    assert found == {"e": (1, day), "f": (0, None)}


def test_an_opener_that_breaks_a_rule_is_not_published(spark):
    brief = [("p", "Desk", "answer " * 80, "late orders")]
    briefs_ = spark.createDataFrame(brief, "product_id string, product string, promised_outcome string, job_to_be_done string")
    df = spark.createDataFrame([("p", "e", "word " * 150, "pain")], "product_id string, entity_key string, source_title string, best_bucket string")
    drafted = outreach.lint_openers(outreach.draft_openers(df, briefs_)).first()
    assert "word ..." in drafted.opener and not drafted.passes and drafted.problems == ["too_long"]


def test_icp_terms_are_those_of_the_product(spark):
    terms = spark.createDataFrame(
        [
            ("a", "primary", "positive", "gym owner"),
            ("a", "adjacent", "positive", "studio"),
            ("a", "adjacent", "trigger", "new location"),
            ("a", "primary", "disqualifier", "hobby"),
            ("b", "primary", "positive", "studio"),
        ],
        "product_id string, icp_role string, kind string, phrase string",
    )
    df = spark.createDataFrame(
        [
            (1, "a", "A gym owner with a studio."),
            (2, "a", "Studio at a new location, just a hobby"),
            (3, "b", "gym owner, studio"),
            (4, "c", "studio"),
            (5, "a", "gym. Owner"),
        ],
        "signal_id int, product_id string, text string",
    )
    expected = {
        1: (["gym owner", "studio"], "primary", False, False),
        2: (["new location", "studio"], "adjacent", True, True),
        3: (["studio"], "primary", False, False),
        4: ([], None, False, False),
        5: ([], None, False, False),
    }
    for match in (matching.match_icp, matching.match_icp_by_join):
        found = match(df, terms).collect()
        assert {r.signal_id: (r.fit_terms, r.icp_role, r.icp_trigger, r.disqualified) for r in found} == expected


def test_too_many_folded_terms_are_an_error(spark):
    count = matching.MAX_FOLDED_TERMS + 5
    terms = spark.range(count).select(
        F.lit("p").alias("product_id"), F.lit("primary").alias("icp_role"), F.lit("positive").alias("kind"),
        F.concat(F.lit("w"), "id").alias("phrase"),
    )
    df = spark.createDataFrame([(1, "p", f"w{count - 1}")], "signal_id int, product_id string, text string")
    with pytest.raises(Exception, match="match_icp_by_join"):
        matching.match_icp(df, terms).collect()
    assert matching.match_icp_by_join(df, terms).first().fit_terms == [f"w{count - 1}"]


# --- Policy ---


def test_source_policy(spark):
    df = spark.createDataFrame(
        [
            (1, "forum", "https://ok.com/1"),
            (2, "data_broker", "https://ok.com/2"),
            (3, "forum", "https://www.Bad.com/3"),
            (4, None, None),
        ],
        "signal_id int, source_type string, source_url string",
    )
    hosts = spark.createDataFrame([("bad.com",)], "host string")
    assert rows(policy.apply_source_policy(df), "signal_id") == [(1,), (3,), (4,)]
    assert rows(policy.apply_source_policy(df, blocked_hosts=hosts), "signal_id") == [(1,), (4,)]


def test_originals_and_sensitive_terms(spark):
    df = spark.createDataFrame(
        [
            (1, True, "https://x.com/a", "fine"),
            (2, True, "http://www.x.com/b?ref=s", "fine"),
            (3, False, None, "about her health"),
            (4, None, "bad", "Healthy"),
            (5, True, None, "fine"),
        ],
        "signal_id int, is_snippet boolean, source_url string, text string",
    )
    originals = spark.createDataFrame([("https://x.com/b",), (None,)], "source_url string")
    assert rows(policy.require_original(df, originals), "signal_id") == [(2,), (3,), (4,)]
    assert rows(policy.exclude_sensitive(df, ["health"]), "signal_id") == [(1,), (2,), (4,), (5,)]
    flagged = spark.createDataFrame([(1,), (1,)], "signal_id int")
    assert rows(policy.exclude_sensitive(df, flagged=flagged), "signal_id") == [(2,), (3,), (4,), (5,)]


def test_brief_gate_and_scope(spark):
    facts = {
        "product_id": "p", "product": "P", "promised_outcome": "o", "primary_user": "u", "economic_buyer": "b",
        "job_to_be_done": "j", "current_alternative": "c", "adoption_trigger": "t", "geography": None, "lang": "en",
        "disqualifiers": ["d"],
    }
    schema = ", ".join(f"{k} {'array<string>' if k == 'disqualifiers' else 'string'}" for k in facts)
    others = [{**facts, "lang": " "}, {**facts, "disqualifiers": []}, {**facts, "product": None, "disqualifiers": None}]
    df = spark.createDataFrame([tuple(f.values()) for f in [facts, *others]], schema)
    found = [r.missing for r in briefs.brief_readiness(df).collect()]
    assert found == [[], ["geography_or_language"], ["disqualifiers"], ["product", "disqualifiers"]]

    scope = spark.createDataFrame([("p", dt.date(2024, 6, 30), 3, "en"), ("q", dt.date(2024, 6, 30), 1, None)], "product_id string, as_of date, scope_months int, lang string")
    signals = spark.createDataFrame(
        [
            (1, "p", dt.date(2024, 3, 30), "en"),
            (2, "p", dt.date(2024, 3, 29), "en"),
            (3, "p", dt.date(2024, 6, 1), "fr"),
            (4, "p", None, "en"),
            (5, "q", dt.date(2024, 6, 1), "fr"),
            (6, "q", dt.date(2024, 7, 1), "fr"),
            (7, "none", dt.date(2024, 6, 1), "en"),
        ],
        "signal_id int, product_id string, signal_date date, lang string",
    )
    kept = briefs.in_scope(signals, scope)
    assert [r[0] for r in rows(kept, "signal_id")] == [1, 4, 5]
    assert {r.signal_id: (r.age_days, r.stale) for r in kept.collect()} == {1: (92, False), 4: (None, True), 5: (29, False)}
    bounded = briefs.in_scope(signals, scope, not_before=dt.date(2024, 1, 1))
    assert rows(bounded, "signal_id") == rows(kept, "signal_id")


# --- Scoring, gates and ranks ---


def random_evidence(spark, n=1500, entities=60):
    rng = random.Random(11)
    records = []
    for i in range(n):
        entity = "e0" if rng.random() < 0.33 else f"e{rng.randrange(1, entities)}"
        url = rng.choice([f"https://s.com/{i}", "bad"]) if rng.random() < 0.3 else f"https://s.com/{i}"
        day = None if rng.random() < 0.1 else dt.date(2024, 6, 30) - dt.timedelta(days=rng.randrange(400))
        buckets = rng.sample(BUCKETS, rng.choice([0, 0, 1, 1, 2]))
        records.append((i, rng.choice("pq"), entity, rng.choice(["forum", "issue", "review"]), url, day, buckets))
    return evidence_frame(spark, records), records


def test_profile_counts_equal_brute_force(spark):
    df, records = random_evidence(spark)
    expected = []
    for key in {(r[1], r[2]) for r in records}:
        mine = [r for r in records if (r[1], r[2]) == key]
        days = [r[5] for r in mine if r[5]]
        expected.append(
            (*key, len(mine), *(sum(b in r[6] for r in mine) for b in BUCKETS),
             sum(bool(r[6]) for r in mine), sum(bool(r[6]) and r[4] != "bad" for r in mine),
             len({r[3] for r in mine if r[4] != "bad"}), max(days) if days else None)
        )
    profile = scoring.entity_profile(df)
    columns = ["product_id", "entity_key", "n_signals", *(f"n_{b}" for b in BUCKETS), "n_observed", "n_linked", "n_channels", "newest"]
    assert rows(profile, *columns) == sorted(expected)


def rated(spark):
    from signalsieve.config import ScoringConfig

    df, _ = random_evidence(spark)
    return scoring.score_prospects(df, ScoringConfig(fit_source="buckets"))


def test_gate_and_rejections_split_the_prospects(spark):
    prospects = rated(spark).withColumn("is_disqualified", F.col("entity_key") == "e7").cache()
    keys = ["product_id", "entity_key"]
    accepted, rejected = rows(ranking.primary_gate(prospects), *keys), rows(ranking.rejections(prospects), *keys)
    assert accepted and rejected and not set(accepted) & set(rejected)
    assert sorted(accepted + rejected) == rows(prospects, *keys)
    assert ranking.rejections(prospects).filter("size(reasons) = 0").count() == 0
    assert set(prospects.exceptAll(ranking.primary_gate(prospects)).select(*keys).collect()) == set(rejected)


def test_mode_caps_and_full_ranks(spark):
    products = ["quick", "standard", "deep", "design-partners", "b2b", "community", "odd", None]
    caps = dict(zip(products, [5, 10, 20, 10, 10, 10, 10, 10], strict=True))
    prospects = spark.range(25 * len(products)).select(
        F.concat(F.lit("p"), (F.col("id") % len(products)).cast("string")).alias("product_id"),
        F.col("id").cast("string").alias("entity_key"),
        (50 + F.col("id") % 40).cast("int").alias("score"),
        F.struct(F.lit(3.0).alias("timing")).alias("dimensions"),
        F.lit("High intent").alias("stage"),
        *(F.lit(1).alias(f"n_{c}") for c in [*BUCKETS, "observed", "linked", "discussion"]),
    )
    modes = spark.createDataFrame([(f"p{i}", m) for i, m in enumerate(products)], "product_id string, mode string")
    chosen = ranking.shortlist(prospects, modes)
    sizes = {r.product_id: r["count"] for r in chosen.groupBy("product_id").count().collect()}
    assert sizes == {f"p{i}": caps[m] for i, m in enumerate(products)}
    top = rows(ranking.rank_top(prospects), "product_id", "entity_key", "rank")
    everyone = ranking.rank_all(prospects, partitions=5)
    assert rows(everyone.filter("rank <= 20"), "product_id", "entity_key", "rank") == top


def test_mode_priorities(spark):
    columns = "n_explicit_demand int, n_pain int, n_workaround int, n_switching int, n_timing int, n_discussion int, is_company boolean"
    df = spark.createDataFrame(
        [(1, 0, 0, 0, 0, 1, True), (0, 1, 0, 0, 1, 0, True), (1, 1, 0, 0, 1, 0, False), (0, 0, 0, 0, 0, 0, None)], columns
    )

    def keys(mode):
        return [r[0] for r in df.select(ranking.mode_priority(F.lit(mode))).collect()]

    assert keys("design-partners") == [3, 0, 1, 2]
    assert keys("b2b") == [1, 0, 2, 3]
    assert keys("community") == [0, 3, 1, 3]
    assert keys("quick") == [0, 0, 0, 0]


def test_top_prospect_ties_and_empty_products(spark):
    df = spark.createDataFrame(
        [("p", "late", 90, 2, None, "pain"), ("p", "early", 90, 1, "now", "pain"), ("p", "low", 10, 0, "x", "")],
        "product_id string, entity_name string, score int, input_position int, why_now string, pain_signal string",
    )
    products = spark.createDataFrame([("p",), ("q",)], "product_id string")
    found = rows(ranking.top_prospect(df, products), "product_id", "top_name", "top_score", "top_text")
    assert found == [("p", "early", 90, "now"), ("q", "No qualified prospect", 0, "")]


# --- Aggregates ---


def test_patterns_equal_brute_force(spark):
    df, records = random_evidence(spark)
    expected = []
    for product in "pq":
        for bucket in BUCKETS:
            hits = [r for r in records if r[1] == product and bucket in r[6]]
            expected.append((product, bucket, len({r[2] for r in hits}), [str(r[0]) for r in hits[:3]]))
    assert rows(aggregates.patterns(df), "product_id", "bucket", "count", "samples") == sorted(expected)
    single = evidence_frame(spark, [(1, "p", "only", "forum", "https://x.io", None, ["pain"])])
    assert aggregates.patterns(single).count() == 0


def test_coverage_totals_and_gaps(spark):
    df, records = random_evidence(spark, n=40, entities=5)
    totals = evidence.coverage(df).filter("is_total")
    assert {r.product_id: r.n_signals for r in totals.collect()} == {p: sum(r[1] == p for r in records) for p in "pq"}
    some = evidence_frame(spark, [(1, "p", "e", "forum", None, None, ["pain", "timing"]), (2, "p", "e", "review", None, None, [])])
    gap = evidence.coverage_gaps(some).first()
    assert (gap.n_source_types, gap.missing_buckets) == (2, ["explicit_demand", "workaround", "switching"])


def test_kpis_of_empty_products(spark):
    products = spark.createDataFrame([("p",), ("q",)], "product_id string")
    prospects = spark.createDataFrame([("p", "High intent", 82, (4.0,)), ("p", "x", 83, (1.0,))], "product_id string, stage string, score int, dimensions struct<reachability:double>")
    found = rows(aggregates.verdict(aggregates.report_kpis(prospects, products)), "product_id", "n_prospects", "n_high_intent", "average_score", "verdict_flag")
    assert found == [("p", 2, 1, 82, "emerging"), ("q", 0, 0, 0, "none")]


# --- Outreach and sources ---


def test_seven_day_plan(spark):
    df = spark.range(1, 21).select(F.col("id").cast("int").alias("rank"))
    days = [r[1] for r in rows(outreach.outreach_plan(df), "rank", "day")]
    assert days == [1, 1, 1] + [2, 3, 4, 5, 6, 7] * 2 + [2, 3, 4, 5, 6]


def test_signals_of_several_sources(spark, tmp_path):
    forum = spark.createDataFrame([(1, "a")], "signal_id int, text string")
    issues = spark.createDataFrame([(1, "b", "en")], "signal_id int, text string, lang string")
    merged = union_signals({"forum": forum, "issue": issues})
    assert rows(merged, "signal_id", "source_type", "text") == [("forum:1", "forum", "a"), ("issue:1", "issue", "b")]
    forum.write.parquet(str(tmp_path / "f"))
    issues.write.json(str(tmp_path / "i"))
    assert read_signals(spark, {"forum": str(tmp_path / "f")}).count() == 1
    assert rows(read_signals(spark, {"issue": str(tmp_path / "i")}, "json"), "signal_id", "lang") == [("issue:1", "en")]


def test_folded_terms_are_sent_to_the_texts(spark):
    """Few terms out of a large table do not move the texts by product, on which one product would be one task."""
    terms = spark.range(10**7).filter("id < 3").select(
        F.concat(F.lit("p"), F.col("id") % 2).alias("product_id"), F.lit("primary").alias("icp_role"), F.lit("positive").alias("kind"),
        F.concat(F.lit("w"), "id").alias("phrase"),
    )
    signals = spark.range(10**7).select(F.col("id").alias("signal_id"), F.concat(F.lit("p"), F.col("id") % 2).alias("product_id"), F.lit("a w1 b").alias("text"))
    found = matching.match_icp(signals, terms).groupBy("product_id").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_small_tables_are_spread_by_their_size(spark):
    spread = spread_small(spark.range(100, numPartitions=1), "id")
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan


def test_orders_of_one_row_group_are_spread(spark, tmp_path):
    fields = "id AS o_orderkey, id AS o_custkey, 'F' AS o_orderstatus, 1.0D AS o_totalprice, '1-URGENT' AS o_orderpriority"
    spark.range(20_000, numPartitions=1).selectExpr(*fields.split(", ")).write.parquet(f"{tmp_path}/orders.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "8k")
    try:
        tasks = order_documents(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("body"), F.sum("document_id")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(t[1] for t in tasks) == 20_000 and sum(t[2] for t in tasks) == sum(range(20_000))
    assert len(tasks) > 8 and max(t[1] for t in tasks) < 5_000


def test_few_phrases_are_sent_to_the_texts(spark, monkeypatch):
    lexicon = matching.lexicon_frame(spark, [Phrase("pain", "so slow"), Phrase("timing", "now"), Phrase("pain", "now", "fr")])
    df = spark.createDataFrame([(1, "en", "It is so, slow"), (2, "fr", "So slow now"), (3, "en", ""), (4, "en", None)], "signal_id int, lang string, text string")
    hits = matching.phrase_hits(df, lexicon)
    assert "Exchange hashpartitioning" not in hits._jdf.queryExecution().executedPlan().toString()
    sent = sorted(map(tuple, hits.collect()))
    monkeypatch.setattr(matching, "MAX_SENT_PHRASES", 0)
    assert sent == sorted(map(tuple, matching.phrase_hits(df, lexicon).collect())) == [(2, "pain", "now"), (2, "pain", "so slow"), (2, "timing", "now")]
