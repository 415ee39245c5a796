"""Phrase lexicons against signal text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalsieve.config import BUCKETS, MAX_INLINE_PHRASES, Phrase
from signalsieve.functions.numbers import once
from signalsieve.functions.texts import has_phrase, may_have_any, words_if, words_of
from signalsieve.operators.columns import compute_once
from signalsieve.operators.skew import salted_join, stable

_LEXICON = T.StructType(
    [
        T.StructField("bucket", T.StringType()),
        T.StructField("phrase", T.StringType()),
        T.StructField("lang", T.StringType()),
    ]
)
MAX_FOLDED_TERMS = 1000
#: Up to so many different phrases are sent to the texts.
MAX_SENT_PHRASES = 10_000


def lexicon_frame(spark: SparkSession, phrases: Iterable[Phrase]) -> DataFrame:
    return spark.createDataFrame([tuple(p) for p in phrases], _LEXICON)


def _applies(phrase: Phrase, lang: Column | None) -> Column:
    if phrase.lang is None or lang is None:
        return F.lit(True)
    return lang == F.lit(phrase.lang)


def bucket_array(text: Column, phrases: Sequence[Phrase], lang: Column | None = None) -> Column:
    """Distinct buckets hit, in the order of first appearance in ``phrases``."""

    def found(words: Column) -> Column:
        flags = []
        for bucket in dict.fromkeys(p.bucket for p in phrases):
            any_hit = F.lit(False)
            for p in phrases:
                if p.bucket == bucket:
                    any_hit = any_hit | (_applies(p, lang) & has_phrase(words, p.phrase))
            flags.append(F.when(F.coalesce(any_hit, F.lit(False)), F.lit(bucket)))
        return F.array_compact(F.array(*flags))

    return once(words_if(text, may_have_any(p.phrase for p in phrases)), found)


def classify(signals: DataFrame, phrases: Sequence[Phrase], text: str = "text") -> DataFrame:
    """Adds ``buckets``: every bucket whose phrases occur in the text, matched in the row.

    A list of over ``MAX_INLINE_PHRASES`` phrases is joined instead, with the same result. Else one
    pass over the text and no shuffle; texts without the letters of any phrase are not
    even split into words. Phrases with a language match only signals of that language, if
    ``signals`` has a ``lang`` column.
    """
    if len(phrases) > MAX_INLINE_PHRASES:
        return classify_with_lexicon(signals, lexicon_frame(signals.sparkSession, phrases), text)
    lang = F.col("lang") if "lang" in signals.columns else None
    return signals.withColumn("buckets", bucket_array(F.col(text), phrases, lang))


def _anchored(table: DataFrame) -> DataFrame:
    """Rows with a phrase, with its folded words as ``_phrase`` and the longest of them as ``_anchor``."""
    words = F.split("_phrase", " ")
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    folded = table.withColumn("_phrase", F.trim(words_of("phrase"))).filter(F.col("_phrase") != "")
    return folded.withColumn("_anchor", longest)


def _anchor_hits(
    signals: DataFrame, entries: DataFrame, keep: Sequence[str], on: Sequence[str], text: str
) -> DataFrame:
    """Entries whose ``_phrase`` occurs in the text of a signal with equal ``on`` columns.

    The distinct words of a text meet the one anchor word of each phrase by equality. Phrases of a
    single word are found by that; longer ones are looked for in the folded text of the few
    signals that have their anchor. Phrases and lexicons may be of any length. Few phrases are sent to the
    texts, which are then folded once and stay where they are; for many, words and texts are shuffled.
    """
    key = ["signal_id", *on]
    entries = stable(entries)
    if entries.count() <= MAX_SENT_PHRASES:
        folded = compute_once(signals.select("signal_id", *keep, text), _words=words_of(text)).drop(text)
        split = folded.withColumn("_anchor", F.explode_outer(F.array_distinct(F.split(F.trim("_words"), " "))))
        met = split.join(F.broadcast(entries), [*on, "_anchor"])
        stands = F.contains("_words", F.concat(F.lit(" "), "_phrase", F.lit(" ")))
        return met.filter((F.col("_phrase") == F.col("_anchor")) | stands).drop("_words")
    anchors = signals.select(
        "signal_id",
        *keep,
        # The outer form keeps Spark from adding a filter that would split each text twice.
        F.explode_outer(F.array_distinct(F.split(F.trim(words_of(text)), " "))).alias("_anchor"),
    )
    met = salted_join(anchors, entries, [*on, "_anchor"])
    texts = signals.select(*key, words_of(text).alias("_words"))
    longer = met.filter(F.col("_phrase") != F.col("_anchor")).join(texts, key)
    stands = F.contains("_words", F.concat(F.lit(" "), "_phrase", F.lit(" ")))
    return met.filter(F.col("_phrase") == F.col("_anchor")).unionByName(longer.filter(stands).drop("_words"))


def phrase_hits(
    signals: DataFrame,
    lexicon: DataFrame,
    text: str = "text",
) -> DataFrame:
    """One row per (signal_id, bucket, phrase) found, for lexicons of any length.

    Each text becomes its distinct words, which meet one word of each phrase by equality. A short
    lexicon is broadcast by Spark itself and the texts then stay where they are.
    """
    entries = (
        _anchored(lexicon)
        .select("bucket", "phrase", F.col("lang").alias("_lang"), "_phrase", "_anchor")
        .distinct()
    )
    has_lang = "lang" in signals.columns
    hits = _anchor_hits(signals, entries, ["lang"] if has_lang else [], [], text)
    if has_lang:
        hits = hits.filter(F.col("_lang").isNull() | (F.col("_lang") == F.col("lang")))
    return hits.select("signal_id", "bucket", "phrase")


def classify_with_lexicon(
    signals: DataFrame,
    lexicon: DataFrame,
    text: str = "text",
    buckets: Sequence[str] = BUCKETS,
) -> DataFrame:
    """:func:`classify` for a lexicon DataFrame; same result, by a join on words."""
    hits = phrase_hits(signals, lexicon, text)
    seen = hits.groupBy("signal_id").agg(
        *(F.bool_or(F.col("bucket") == b).alias(f"_b{i}") for i, b in enumerate(buckets))
    )
    found = F.array_compact(
        F.array(*(F.when(F.col(f"_b{i}"), F.lit(b)) for i, b in enumerate(buckets)))
    )
    return (
        signals.join(seen, "signal_id", "left")
        .withColumn("buckets", found)
        .drop(*(f"_b{i}" for i in range(len(buckets))))
    )


def match_icp(signals: DataFrame, icp_terms: DataFrame, text: str = "text") -> DataFrame:
    """Adds the ICP view of each signal, from the terms of its own product.

    ``icp_terms`` (product_id, icp_role, kind, phrase) is folded to one short array per product
    first, so that each signal is joined once and its text read once. Adds ``fit_terms``
    (distinct positive and trigger phrases hit), ``icp_role`` (the role with more hits, primary
    on a tie, NULL without hits), ``icp_trigger`` and ``disqualified``. A product with more than
    ``MAX_FOLDED_TERMS`` terms is an error; :func:`match_icp_by_join` takes any number.
    """
    terms = (
        icp_terms.select("product_id", "phrase", "icp_role", "kind")
        .withColumn("words", words_of("phrase"))
        .filter(F.length(F.trim("words")) > 0)
        .distinct()
    )
    in_order = Window.partitionBy("product_id").orderBy("phrase", "icp_role", "kind")
    entry = F.struct(
        "phrase", "icp_role", "kind", "words", F.array_remove(F.split(F.trim("words"), " "), ".").alias("pieces")
    )
    too_many = F.raise_error(
        F.lit(f"a product has more than {MAX_FOLDED_TERMS} ICP terms; use match_icp_by_join")
    )
    # No more than one term beyond the bound is ever collected.
    per_product = (
        terms.withColumn("_n", F.row_number().over(in_order))
        .filter(F.col("_n") <= MAX_FOLDED_TERMS + 1)
        .groupBy("product_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("_terms"))
        .withColumn(
            "_terms", F.when(F.size("_terms") <= MAX_FOLDED_TERMS, F.col("_terms")).otherwise(too_many)
        )
    )
    # As a table its size is known before any text moves: one that fits is sent to the texts, which stay where they are.
    per_product = stable(per_product)
    joined = salted_join(
        signals, per_product, ["product_id"], how="left", spread_on=["signal_id"]
    ).withColumn("_terms", F.coalesce("_terms", F.array().cast(per_product.schema["_terms"].dataType)))

    def possible(low: Column) -> Column:
        return F.exists(
            "_terms", lambda t: F.forall(t["pieces"], lambda piece: F.contains(low, piece))
        )

    hit = once(
        words_if(text, possible),
        lambda words: F.filter("_terms", lambda t: F.contains(words, t["words"])),
    )
    scored = joined.withColumn("_hit", hit)

    def count(role: str) -> Column:
        return F.size(
            F.filter("_hit", lambda t: (t["kind"] != "disqualifier") & (t["icp_role"] == role))
        )

    fits = F.filter("_hit", lambda t: t["kind"] != "disqualifier")
    return scored.select(
        *signals.columns,
        F.array_distinct(F.transform(fits, lambda t: t["phrase"])).alias("fit_terms"),
        F.when((count("primary") > 0) & (count("primary") >= count("adjacent")), F.lit("primary"))
        .when(count("adjacent") > 0, F.lit("adjacent"))
        .alias("icp_role"),
        F.exists("_hit", lambda t: t["kind"] == "trigger").alias("icp_trigger"),
        F.exists("_hit", lambda t: t["kind"] == "disqualifier").alias("disqualified"),
    )


def match_icp_by_join(
    signals: DataFrame, icp_terms: DataFrame, text: str = "text"
) -> DataFrame:
    """:func:`match_icp` for any number of terms per product; same result, by a join on words.

    A signal that stands under two products is matched with the terms of each.
    """
    entries = _anchored(icp_terms.select("product_id", "phrase", "icp_role", "kind")).distinct()
    hits = _anchor_hits(signals, entries, ["product_id"], ["product_id"], text)
    fits = F.col("kind") != "disqualifier"
    seen = hits.groupBy("signal_id", "product_id").agg(
        F.array_sort(F.collect_set(F.when(fits, F.col("phrase")))).alias("_fit"),
        F.count_if(fits & (F.col("icp_role") == "primary")).alias("_primary"),
        F.count_if(fits & (F.col("icp_role") == "adjacent")).alias("_adjacent"),
        F.bool_or(F.col("kind") == "trigger").alias("_trigger"),
        F.bool_or(~fits).alias("_struck"),
    )
    return signals.join(seen, ["signal_id", "product_id"], "left").select(
        *signals.columns,
        F.coalesce("_fit", F.array().cast("array<string>")).alias("fit_terms"),
        F.when((F.col("_primary") > 0) & (F.col("_primary") >= F.col("_adjacent")), F.lit("primary"))
        .when(F.col("_adjacent") > 0, F.lit("adjacent"))
        .alias("icp_role"),
        F.coalesce("_trigger", F.lit(False)).alias("icp_trigger"),
        F.coalesce("_struck", F.lit(False)).alias("disqualified"),
    )
