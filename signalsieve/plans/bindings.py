"""The test tables seen as signals, entities, briefs and report documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsieve.config import Phrase, ScoringConfig
from signalsieve.functions.urls import url_host
from signalsieve.operators.briefs import freshness
from signalsieve.operators.scoring import entity_profile, rate_prospects
from signalsieve.operators.skew import salted_join, spread_rows, spread_small

AS_OF = dt.date(2001, 8, 1)

# Step sizes for orders as signals.
ORDER_CONFIG = ScoringConfig(
    pain_per_hit=2.0,
    fit_source="buckets",
    fit_base=1.0,
    trigger_bonus=0,
    reach_per_channel=2.0,
    reliability_weight=0.0,
    evidence_per_signal=1.0,
    evidence_base=1.0,
)
EVENT_CONFIG = ScoringConfig(fit_source="buckets")

# Stand-in lexicon: words and word pairs that occur in the test texts.
STAND_IN_LEXICON = [
    Phrase("explicit_demand", "the for"),
    Phrase("pain", "was"),
    Phrase("workaround", "this"),
    Phrase("switching", "from the"),
    Phrase("timing", "worthless"),
]
LANGUAGE_LEXICON = [
    Phrase("explicit_demand", "the for", "en"),
    Phrase("pain", "was", "en"),
    Phrase("pain", "und", "de"),
    Phrase("workaround", "avec", "fr"),
    Phrase("workaround", "para", "es"),
    Phrase("switching", "de la", "fr"),
    Phrase("switching", "de la", "es"),
    Phrase("timing", "worthless"),
]
SENSITIVE_STAND_IN = ["worthless", "idiots"]


# Syllables of the names of customers, one per digit; any two differ in two letters or more.
SYLLABLES = ["bal", "cen", "dir", "fos", "gum", "hax", "jep", "kit", "lov", "muz"]
EVENT_GAP, EVENT_LATENESS = "24 hours", "12 hours"
SHARED_SITES = ("forum.example", "social.example")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _priority_bucket() -> Column:
    """Bucket by the leading digit of the priority; 5 carries no bucket."""
    digit = F.substring("o_orderpriority", 1, 1)
    found = [
        F.when(digit == "1", F.lit("explicit_demand"))
        .when(digit == "2", F.lit("pain"))
        .when(digit == "3", F.lit("workaround"))
        .when(digit == "4", F.lit("timing"))
    ]
    return F.array_compact(F.array(*found))


def order_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as signals of customers: old ones are stale, those of status P have no date, and
    every seventh has a URL that is no web page."""
    orders = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    scheme = F.when(F.col("o_orderkey") % 7 == 0, F.lit("ftp")).otherwise(F.lit("https"))
    return freshness(orders.select(
        F.col("o_orderkey").alias("signal_id"),
        F.col("o_custkey").alias("entity_key"),
        F.when(status == "F", F.lit("forum"))
        .when(status == "O", F.lit("company_page"))
        .otherwise(F.lit("social_post"))
        .alias("source_type"),
        F.when(status == "F", F.lit(60)).when(status == "O", F.lit(90)).otherwise(F.lit(40)).alias("reliability"),
        F.when(status != "P", F.to_date("o_orderdate")).alias("signal_date"),
        _priority_bucket().alias("buckets"),
        F.concat(scheme, F.lit("://orders.example/"), F.col("o_orderkey").cast("string")).alias("source_url"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("source_title"),
        F.lit(AS_OF).alias("as_of"),
        F.lit(12).alias("scope_months"),
    )).drop("age_days")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities; the market segment is the product they may fit."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity_key"),
        F.col("c_mktsegment").alias("product_id"),
        F.col("c_name").alias("entity_name"),
        (F.col("c_nationkey") < 12).alias("is_company"),
        (F.col("c_acctbal") < 0).alias("is_disqualified"),
    )


def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five profiles of each customer, as sources would show it: its own page, a directory entry in
    capitals with a legal form, a forum name with a letter missing, a social handle and a shop page.

    A customer's number gives its name; ``profile_id`` is the number times eight plus the kind."""
    key = F.col("c_custkey")
    digits = F.lpad(((key + 1) * 617_920_037 % 1_000_000_000).cast("string"), 9, "0")
    part = lambda i: F.element_at(F.array(*map(F.lit, SYLLABLES)), F.substring("_digits", i, 1).cast("int") + 1)
    words = [F.concat(*(part(i) for i in range(k, k + 3))) for k in (1, 4, 7)]
    # Names take long to work out and a customer's number is all they need: a file of few row groups is dealt out to all cores.
    keys = table(spark, sf_dir, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism, "c_custkey")
    named = keys.select("c_custkey", digits.alias("_digits")).select(
        "c_custkey", *(w.alias(f"_{i}") for i, w in enumerate(words))
    )
    name, compact, handle = F.initcap(F.concat_ws(" ", "_0", "_1", "_2")), F.concat("_0", "_1", "_2"), F.concat_ws("_", "_0", "_1", "_2")
    at = (key % 15 + 12).cast("int")
    typo = F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.lit(99)))
    text = F.lit(None).cast("string")
    kinds = [
        (1, name, F.when(key % 3 == 0, F.concat(F.lit("www."), compact, F.lit(".example"))), text),
        (2, F.concat(F.upper(name), F.lit(", INC.")), text, F.concat(F.lit("@"), handle)),
        (3, typo, F.lit("forum.example"), text),
        (5, text, F.lit("m.social.example"), handle),
        (6, text, F.concat(F.lit("shop."), compact, F.lit(".example")), text),
    ]
    profiles = F.array(
        *(
            F.when(
                key % every == 0,
                F.struct((key * 8 + i).alias("profile_id"), n.alias("name"), h.alias("host"), a.alias("handle")),
            )
            for i, (every, n, h, a) in enumerate(kinds)
        )
    )
    return named.select(F.inline(F.array_compact(profiles)))


def order_evidence(spark: SparkSession, sf_dir: str, signals: DataFrame | None = None) -> DataFrame:
    """Order signals with their product and entity name."""
    return salted_join(order_signals(spark, sf_dir) if signals is None else signals, customers(spark, sf_dir), ["entity_key"])


def order_prospects(
    spark: SparkSession, sf_dir: str, config: ScoringConfig = ORDER_CONFIG, signals: DataFrame | None = None
) -> DataFrame:
    """One rated prospect per customer with an order.

    Orders are aggregated by customer before customers are joined, so a customer with very
    many orders is one row by then and the join has unique keys on both sides.
    """
    profile = entity_profile(order_signals(spark, sf_dir) if signals is None else signals, ["entity_key"])
    return rate_prospects(profile, config).join(customers(spark, sf_dir), "entity_key")


def segment_briefs(spark: SparkSession, sf_dir: str, modes: bool = False) -> DataFrame:
    """One brief per market segment found in the customer table."""
    segment = F.col("product_id")
    mode = F.lit("standard")
    months = F.lit(12)
    if modes:
        mode = (
            F.when(segment == "AUTOMOBILE", F.lit("quick"))
            .when(segment == "BUILDING", F.lit("deep"))
            .when(segment == "FURNITURE", F.lit("design-partners"))
            .when(segment == "HOUSEHOLD", F.lit("b2b"))
            .otherwise(F.lit("community"))
        )
        months = F.when(segment == "AUTOMOBILE", F.lit(3)).when(segment == "BUILDING", F.lit(24)).otherwise(F.lit(12))
    name = F.initcap(F.lower(segment))
    return (
        customers(spark, sf_dir)
        .select("product_id")
        .distinct()
        .select(
            "product_id",
            F.concat(name, F.lit(" Desk")).alias("product"),
            F.concat(F.lit("https://"), F.lower(segment), F.lit(".example")).alias("product_url"),
            F.lit("answer every order on time").alias("promised_outcome"),
            F.lit("order clerk").alias("primary_user"),
            F.lit("owner").alias("economic_buyer"),
            F.lit("late orders").alias("job_to_be_done"),
            F.lit("spreadsheets").alias("current_alternative"),
            F.lit("a growing backlog").alias("adoption_trigger"),
            F.lit(None).cast("string").alias("geography"),
            F.lit(None).cast("string").alias("lang"),
            F.concat(name, F.lit(" buyers")).alias("target_customer"),
            F.array(F.lit("negative balance")).alias("disqualifiers"),
            mode.alias("mode"),
            F.lit(AS_OF).alias("as_of"),
            months.alias("scope_months"),
        )
    )


def event_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as signals of users. A small value carries no bucket."""
    kinds = {
        "signup": "explicit_demand",
        "error": "pain",
        "click": "workaround",
        "purchase": "switching",
        "view": "timing",
    }
    bucket = F.lit(None).cast("string")
    for kind, name in kinds.items():
        bucket = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(bucket)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("signal_id"),
        F.lit("app").alias("product_id"),
        F.col("user_id").alias("entity_key"),
        F.col("event_type").alias("source_type"),
        F.to_date("ts").alias("signal_date"),
        F.array_compact(F.array(F.when(F.col("value") >= 150, bucket))).alias("buckets"),
        F.concat(F.lit("https://events.example/"), F.col("event_id").cast("string")).alias("source_url"),
        F.lit(dt.date(2024, 2, 1)).alias("as_of"),
    )


def arriving_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signals with a short text, and the microsecond of their arrival, up to nine hours late."""
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("signal_id"),
        at.alias("event_time"),
        F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("text"),
        (F.unix_micros(at) + F.col("event_id") % 10 * 3_600_000_000).alias("arrival"),
    )


def document_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as signal texts; their source is the entity."""
    return spread_small(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("signal_id"),
        F.col("source").alias("entity_key"),
        "lang",
        "text",
    )


def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sources; their host is the entity."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("signal_id"),
        F.col("url").alias("source_url"),
        url_host("url").alias("entity_key"),
        F.col("html").alias("text"),
    )


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with links to originals: of every eight, three lie on a chain, two on a cycle, one sends readers on
    to a page of its site that is not in the table, and two name none."""
    pages = page_signals(spark, sf_dir)
    last = F.col("signal_id") % 8
    step = F.when(last.isin(0, 1, 2), 1).when(last == 4, 1).when(last == 5, -1)
    target = pages.select((F.col("signal_id")).alias("_to"), F.col("source_url").alias("_target"))
    joined = pages.withColumn("_to", F.col("signal_id") + step).join(target, "_to", "left")
    canonical = F.concat(F.lit("<link rel='canonical' href='"), F.col("_target"), F.lit("'>"))
    refresh = F.lit('<meta http-equiv="refresh" content="0; url=/moved?x=1&amp;y=2">')
    tag = F.when(F.col("_target").isNotNull(), canonical).when(last == 6, refresh).otherwise(F.lit(""))
    return joined.select("signal_id", "source_url", F.replace("text", F.lit("</title>"), F.concat(F.lit("</title>"), tag)).alias("text"))


def language_icp_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ICP terms per product, one product per document language."""
    terms = [
        ("primary", "positive", "was"),
        ("primary", "trigger", "this"),
        ("primary", "positive", "una"),
        ("adjacent", "positive", "de la"),
        ("adjacent", "positive", "the"),
        ("adjacent", "trigger", "und"),
        ("primary", "disqualifier", "worthless"),
    ]
    listed = F.array(
        *(
            F.struct(F.lit(r).alias("icp_role"), F.lit(k).alias("kind"), F.lit(p).alias("phrase"))
            for r, k, p in terms
        )
    )
    languages = table(spark, sf_dir, "documents").select(F.col("lang").alias("product_id")).distinct()
    return languages.select("product_id", F.inline(listed))


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a report document, with the irregularities imports have to cope with.

    Status P gives a lone prospect object instead of a list, and a few priorities give text
    that is no JSON object.
    """
    price = (F.col("o_totalprice") / 5000).cast("string")
    digit = F.substring("o_orderpriority", 1, 1)
    key = F.col("o_orderkey").cast("string")
    first = F.concat(
        F.lit('{"name":"Buyer '), F.col("o_custkey").cast("string"),
        F.lit('","stage":"'), F.when(digit == "1", F.lit("High intent")).when(digit == "2", F.lit("Problem aware")).otherwise(F.lit("Trigger present")),
        F.lit('","score":"'), price,
        F.lit('","source_url":"'), F.when(digit == "3", F.lit("ftp://orders.example/")).otherwise(F.lit("https://orders.example/")), key,
        F.lit('","why_now":'), F.when(digit == "2", F.lit("null")).otherwise(F.lit('"recent"')),
        F.lit(',"dimensions":{"pain_strength":'), digit,
        F.lit(',"product_fit":"'), digit, F.lit('.5","timing":9,"reachability":true}}'),
    )
    second = F.concat(F.lit('{"score":'), digit, F.lit('0,"pain_signal":"late","dimensions":[1]}'))
    listed = F.when(F.col("o_orderstatus") == "P", first).otherwise(
        F.concat(F.lit("["), second, F.lit(',7,"x",'), first, F.lit("]"))
    )
    good = F.concat(
        F.lit('{"title":"Order '), key, F.lit('","product":null,"prospects":'), listed,
        F.lit(',"patterns":{"title":"late","count":"'), key, F.lit('"},"limits":'),
        F.when(digit == "1", F.lit('["a","b"]')).otherwise(F.lit("null")), F.lit("}"),
    )
    body = F.when(digit == "4", F.concat(F.lit("["), key, F.lit("]"))).when(
        digit == "5", F.concat(F.lit('{"title":'), key)
    ).otherwise(good)
    orders = spread_rows(table(spark, sf_dir, "orders"), "o_orderkey")
    return orders.select(F.col("o_orderkey").alias("document_id"), body.alias("body"))
