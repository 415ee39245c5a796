"""Whole runs, registered queries and the shape of their plans."""

import datetime as dt
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from signalsieve.plans import bindings
from signalsieve.plans.oracles import all_oracles
from signalsieve.plans.qualification import qualify
from signalsieve.plans.queries import all_queries
from signalsieve.operators.reporting import report_json, validate_reports
from signalsieve.schemas import BRIEFS, ICP_TERMS, SIGNALS
from signalsieve.sources.reports import import_reports, parse_documents
from signalsieve.streaming.intake import append_evidence, evidence_stream
from tests.oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_sql():
    assert all_queries().keys() == all_oracles().keys()


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_its_sql(spark, duck, name):
    assert compare(all_queries()[name](spark, SMALL), duck, all_oracles()[name]) == ""


ODD_TEXTS = [
    None, None, "", "", "  ", "\t\n", "\u00a0", "\x0b", "\x0b \x0b", "a\x0bb", "a b", "A\u3000B ", "\u2028a\r\fb", "İzmir", "izmir", "i̇zmir",
    "ΟΔΟΣ", "οδοσ", "οδος", "ΟΔΟΣ ΟΔΟΣ", "STRASSE", "straße", "ẞ", "ß", "K", "k", "x\u200by", "x y", "x\x1cy", "x\u0085y",
]


@pytest.mark.parametrize("name", ["distinct_documents", "document_copies"])
def test_blank_missing_and_odd_texts_equal_the_sql(spark, tmp_path, name):
    rows = [(i, text) for i, text in enumerate(ODD_TEXTS, 1)] + [(None, "a b"), (None, "no id"), (None, None), (90, "no id"), (90, "no id")]
    documents = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(all_queries()[name](spark, str(tmp_path)), duck, all_oracles()[name]) == ""


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_query_multiplies_rows_or_leaves_the_jvm(spark, name):
    plan = physical_plan(all_queries()[name](spark, SMALL))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "CollectLimit"):
        assert operator not in plan


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship(spark):
    found = contract.entry(spark)
    assert found.count() == 50
    assert found.schema.names == ["product_id", "rank", "entity_key", "entity_name", "score", "band", "stage"]


def test_flagship_plan(spark):
    plan = physical_plan(all_queries()["shortlist_by_product"](spark, SMALL))
    # The columns reach the scan; products are cut before the shuffle.
    scanned = re.search(r"ReadSchema: struct<o_orderkey[^>]*>", plan).group()
    assert "o_totalprice" not in scanned
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["distinct_documents", "distinct_pages", "order_patterns", "shortlist_by_mode"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    plan = physical_plan(all_queries()[name](spark, SMALL))
    assert plan.count("WindowGroupLimit") >= 2 and ", Partial" in plan


def test_texts_are_split_into_words_once(spark):
    for name in ("bucket_hits", "icp_matches", "bucket_hits_by_join", "document_copies"):
        plan = physical_plan(all_queries()[name](spark, SMALL))
        scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "documents" in line]
        per_scan = plan.count("lower(coalesce(text") + plan.count("lower(text")
        assert per_scan <= len(scans), name


# --- A whole run over planted signals ---

TODAY = dt.date(2026, 6, 30)


def signal(i, product, name, text, kind="forum", days=10, url="default", lang="en", entity_type="company"):
    url = f"https://{kind}.example/{i}" if url == "default" else url
    day = None if days is None else TODAY - dt.timedelta(days=days)
    return (f"s{i}", product, None, name, entity_type, url, f"Thread {i}", kind, day, lang, text, False)


PLANTED = [
    signal(1, "gym", "Harbor Gym", "Payment reminders: the manual follow-up takes hours. Any gym owner here?"),
    signal(2, "gym", "harbor-gym", "We are looking for a tool for membership reminders", "company_page", days=3),
    signal(3, "gym", "HARBOR GYM", "Membership chaos: spreadsheets everywhere, mail me at a@b.example.com", "product_review", days=40),
    signal(4, "gym", "Copycat", "payment reminders:  the MANUAL follow-up takes hours. Any gym owner here?", days=9),
    signal(5, "gym", "Fit Only", "A gym owner writes about membership", days=5),
    signal(6, "gym", "Old Times", "hate this", days=500),
    signal(7, "gym", "Broker Co", "looking for reminders", "data_broker"),
    signal(8, "gym", "Hobby Club", "Looking for membership reminders, we are a hobby club, manual work, gym owner", days=1),
    signal(9, "gym", "Ailing", "looking for help with her illness and membership"),
    signal(10, "gym", "Linkless", "looking for membership reminders, gym owner, difficult", url="nope"),
    signal(11, "gym", "Le Gym", "looking for membership", lang="fr"),
    signal(12, "vet", "Vet Clinic", "Hiring for our expansion of bookings", days=None),
    signal(13, "gone", "Nobody", "looking for anything"),
    signal(14, "gym", "Silent", "nothing to see"),
]


def brief(product, outcome="collect dues", mode="standard"):
    return (product, product.title() + "Flow", f"https://{product}.example", outcome, "clerk", "owner", "late dues", "lists", "growth", None, "en", "owners", ["hobby"], mode, TODAY, 12)


@pytest.fixture(scope="module")
def run(spark):
    briefs = spark.createDataFrame([brief("gym"), brief("vet"), brief("empty"), brief("gone", outcome="")], BRIEFS)
    terms = [("gym", "primary", "positive", "gym owner"), ("gym", "primary", "positive", "membership"), ("gym", "adjacent", "positive", "reminders"), ("gym", "primary", "disqualifier", "hobby"), ("vet", "primary", "positive", "bookings")]
    return qualify(
        briefs,
        spark.createDataFrame(PLANTED, SIGNALS),
        spark.createDataFrame(terms, ICP_TERMS),
        sensitive_terms=["illness"],
        reliability=spark.createDataFrame([("forum", 60), ("company_page", 90)], "source_type string, reliability int"),
    )


def test_evidence_is_allowed_scoped_and_unique(run):
    assert sorted(r.signal_id for r in run.evidence.collect()) == ["s1", "s10", "s12", "s2", "s3", "s5", "s6", "s8"]
    assert run.evidence.filter("signal_id = 's6'").first().stale
    third = run.evidence.filter("signal_id = 's3'").first()
    assert "[email]" in third.text and third.policy_flags == ["email"]


def test_prospects_merge_and_gate(run):
    found = {r.entity_key: r for r in run.prospects.collect()}
    assert set(found) == {"harbor gym", "fit only", "hobby club", "linkless", "old times", "vet clinic"}
    gym = found["harbor gym"]
    assert (gym.n_signals, gym.stage, gym.n_channels, gym.n_fit_terms) == (3, "High intent", 3, 3)
    # pain 2 hits * 1.5 = 3, fit 3, timing 5, reach 5, evidence 0.03 * 200 / 3 + 1.5 = 3.5
    assert tuple(gym.dimensions) == pytest.approx((3.0, 3.0, 5.0, 5.0, 3.5))
    assert gym.score == 76 and gym.band == "promising"
    assert [r.entity_key for r in run.shortlist.collect()] == ["harbor gym"]
    reasons = {r.entity_key: r.reasons for r in run.rejected.collect()}
    assert reasons["fit only"] == ["no_signal", "bad_url", "low_score", "potential_fit"]
    assert "disqualified" in reasons["hobby club"] and "bad_url" in reasons["linkless"]
    assert set(reasons) == {"fit only", "hobby club", "linkless", "old times", "vet clinic"}


def test_entities_that_fell_out_before_scoring(run):
    found = {(r.product_id, r.entity_key): r.reasons for r in run.dropped.collect()}
    assert found == {
        ("gym", "copycat"): ["duplicate"],
        ("gym", "broker co"): ["source_type"],
        ("gym", "ailing"): ["sensitive"],
        ("gym", "le gym"): ["language"],
        ("gym", "silent"): ["no_signal"],
        ("gone", "nobody"): ["brief"],
    }


def test_coverage_and_breakdown(run):
    total = {r.product_id: r.n_signals for r in run.coverage.filter("is_total").collect()}
    assert total == {"gym": 7, "vet": 1}
    assert run.breakdown.count() == 5 * run.prospects.count()


def test_scoring_does_not_read_texts(run):
    for df in (run.prospects, run.patterns, run.coverage):
        for schema in re.findall(r"ReadSchema: (\S+)", df._jdf.queryExecution().executedPlan().toString()):
            assert "text:" not in schema


def test_ledger_and_outreach(run):
    assert sorted(r.signal_id for r in run.ledger.collect()) == ["s1", "s2", "s3"]
    draft = run.outreach.first()
    assert (draft.passes, draft.day, draft.status) == (True, 1, "draft")
    assert draft.best_bucket == "explicit_demand" and "Thread 2" in draft.opener
    assert draft.suggested_channel == "Use the contact form on the company page"


def test_reports_cover_every_product_and_read_back(spark, run):
    reports = run.reports.cache()
    assert validate_reports(reports).filter("NOT passed").count() == 0
    found = {r.product_id: r for r in reports.collect()}
    assert set(found) == {"gym", "vet", "empty", "gone"}
    assert found["gym"].top_prospect.name and found["gym"].prospects[0].score == 76
    assert found["empty"].top_prospect.name == "No qualified prospect" and found["empty"].prospects == []
    again, bad = parse_documents(report_json(reports).withColumnRenamed("report", "body"))
    assert bad.count() == 0
    back = {r.product_id: r for r in import_reports(again).collect()}
    assert back["gym"].n_prospects == 1 and back["gym"].top_score == 76
    assert back["gym"].prospects[0].source_url == "https://company_page.example/2"


def test_copies_change_nothing(spark, run):
    again = qualify(
        spark.createDataFrame([brief("gym")], BRIEFS),
        spark.createDataFrame(PLANTED + [(f"t{s[0]}", *s[1:]) for s in PLANTED], SIGNALS),
        spark.createDataFrame([("gym", "primary", "positive", t) for t in ("gym owner", "membership", "reminders")], ICP_TERMS),
        sensitive_terms=["illness"],
        materialise=lambda df: df,
    )
    gym = again.prospects.filter("entity_key = 'harbor gym'").first()
    assert (gym.n_signals, gym.n_observed) == (3, 3)


# --- Streaming ---


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    signals = spark.createDataFrame(PLANTED, SIGNALS)
    signals.repartition(3).write.parquet(source)
    batch = evidence_stream(signals)
    stream = evidence_stream(spark.readStream.schema(SIGNALS).parquet(source))
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    for _ in range(2):  # the second run finds nothing new
        append_evidence(stream, out, marks).awaitTermination(120)
    columns = ["signal_id", "buckets", "evidence_kind", "text"]
    assert sorted(map(tuple, spark.read.parquet(out).select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))


def test_bindings_keep_whole_tables(spark):
    for build, name in ((bindings.document_signals, "documents"), (bindings.page_signals, "pages"), (bindings.event_evidence, "events"), (bindings.order_documents, "orders")):
        assert build(spark, SMALL).count() == bindings.table(spark, SMALL, name).count()
    assert bindings.order_signals(spark, SMALL).agg(F.count("*")).first()[0] == 1500
