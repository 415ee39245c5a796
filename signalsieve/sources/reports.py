"""Report documents: JSON in, normalised rows out, and reports written back.

A document is one row from start to end, so nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsieve.config import (
    DEFAULT_LIMIT,
    DIMENSION_LABELS,
    DOCUMENT_DEFAULTS,
    DOCUMENT_TITLE,
    NO_PROSPECT,
    PATTERN_COUNT_LIMIT,
    PATTERN_DEFAULTS,
    PLAN_DEFAULTS,
    PROSPECT_DEFAULTS,
)
from signalsieve.functions.numbers import clamp, once, parse_number
from signalsieve.functions.scores import is_high_intent, stage_class
from signalsieve.functions.urls import safe_url
from signalsieve.operators.columns import compute_once


def read_documents(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """(document_id, body) rows: one document per file, or one per line of JSON-lines files."""
    lines = spark.read.text(path, wholetext=not one_per_line)
    file_path = F.col("_metadata.file_path")
    if one_per_line:
        place = F.concat_ws(
            "#", file_path, F.col("_metadata.file_block_start").cast("string"), F.monotonically_increasing_id().cast("string")
        )
        return lines.filter(F.trim("value") != "").select(place.alias("document_id"), F.col("value").alias("body"))
    return lines.select(file_path.alias("document_id"), F.col("value").alias("body"))


def parse_documents(documents: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Splits documents into JSON objects (with a VARIANT ``document``) and a quarantine.

    Broken JSON, arrays and scalars go to the quarantine with a reason; no document stops a job.
    """
    raw = F.col(body)
    parsed = compute_once(documents, document=F.try_parse_json(raw), _brace=raw.rlike(r"^\s*\{"))
    # Valid JSON that opens with a brace is an object; its whole schema need not be worked out.
    is_object = F.col("document").isNotNull() & F.col("_brace")
    good = parsed.filter(is_object).drop(body, "_brace")
    reason = F.when(F.col("document").isNull(), F.lit("not_json")).otherwise(F.lit("not_an_object"))
    quarantine = (
        parsed.filter(~F.coalesce(is_object, F.lit(False)))
        .withColumn("reason", reason)
        .drop("document", "_brace")
    )
    return good, quarantine


def read_reports(
    spark: SparkSession, path: str, one_per_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    return parse_documents(read_documents(spark, path, one_per_line))


def _is_absent_or_null(value: Column) -> Column:
    return value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))


def list_items(document: Column, path: str) -> Column:
    """ARRAY<VARIANT> at ``path``: absent or null gives none, a lone value gives one."""
    value = F.try_variant_get(document, path, "variant")
    listed = F.try_variant_get(document, path, "array<variant>")
    return F.when(_is_absent_or_null(value), F.array().cast("array<variant>")).otherwise(
        F.coalesce(listed, F.array(value))
    )


def object_items(document: Column, path: str) -> Column:
    """:func:`list_items` as (item, fields) pairs, without anything that is not an object.

    Positions count what is left. ``fields`` is :func:`_fields`, which only objects have.
    """
    pairs = F.transform(
        list_items(document, path), lambda x: F.struct(x.alias("item"), _fields(x).alias("fields"))
    )
    return F.filter(pairs, lambda pair: pair["fields"].isNotNull())


def _fields(value: Column) -> Column:
    """MAP of an object's fields as text; a null field is a key without a value."""
    return F.try_variant_get(value, "$", "map<string,string>")


def _is_boolean(value: Column, path: str, text: Column) -> Column:
    """Whether a field is a JSON boolean; its type is only looked up if its text says so."""
    return text.isin("true", "false") & (
        F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "BOOLEAN"
    )


def _text(value: Column, path: str) -> Column:
    """A present field or list item as text: empty for null, capitalised for a boolean."""
    text = F.try_variant_get(value, path, "string")
    return F.when(_is_boolean(value, path, text), F.initcap(text)).otherwise(F.coalesce(text, F.lit("")))


def text_field(value: Column, fields: Column, name: str, default: Column | str) -> Column:
    """Text of a field: ``default`` only if the field is absent, empty if it is null.

    ``fields`` is :func:`_fields` of ``value``, made once for all fields of an object.
    """
    text = F.try_element_at(fields, F.lit(name))
    fallback = F.lit(default) if isinstance(default, str) else default
    return (
        F.when(text.isNull(), F.when(F.map_contains_key(fields, name), F.lit("")).otherwise(fallback))
        .when(_is_boolean(value, f"$.{name}", text), F.initcap(text))
        .otherwise(text)
    )


def number_field(value: Column, fields: Column, path: str, name: str, maximum: int) -> Column:
    """Clamped number of a field, whatever JSON type it has."""
    text = F.try_element_at(fields, F.lit(name))
    number = F.when(_is_boolean(value, f"{path}.{name}", text), (text == "true").cast("double")).otherwise(
        parse_number(text)
    )
    return clamp(number, maximum)


def dimension_struct(prospect: Column) -> Column:
    """The five ratings, each clamped to 0-5; anything but an object counts as all zero."""

    def ratings(fields: Column) -> Column:
        return F.struct(
            *(number_field(prospect, fields, "$.dimensions", name, 5).alias(name) for name in DIMENSION_LABELS)
        )

    return once(F.try_variant_get(prospect, "$.dimensions", "map<string,string>"), ratings)


def prospect_struct(pair: Column, position: Column) -> Column:
    """Normalised prospect. ``position`` is its 1-based place among the listed objects."""
    prospect, fields = pair["item"], pair["fields"]
    texts = {
        name: text_field(prospect, fields, name, default)
        for name, default in PROSPECT_DEFAULTS.items()
    }
    numbered = F.concat(F.lit("Prospect "), position.cast("string"))
    return F.struct(
        position.cast("int").alias("input_position"),
        text_field(prospect, fields, "name", numbered).alias("name"),
        *(text.alias(key) for key, text in texts.items()),
        safe_url(text_field(prospect, fields, "source_url", "")).alias("source_url"),
        number_field(prospect, fields, "$", "score", 100).alias("score"),
        dimension_struct(prospect).alias("dimensions"),
        stage_class(texts["stage"]).alias("stage_class"),
    )


def pattern_struct(pair: Column, position: Column) -> Column:
    pattern, fields = pair["item"], pair["fields"]
    return F.struct(
        position.cast("int").alias("input_position"),
        *(
            text_field(pattern, fields, name, default).alias(name)
            for name, default in PATTERN_DEFAULTS.items()
        ),
        number_field(pattern, fields, "$", "count", PATTERN_COUNT_LIMIT).alias("count"),
    )


def _inlined(documents: DataFrame, path: str, build) -> DataFrame:
    keys = [c for c in documents.columns if c != "document"]
    # The outer form, as a plain one makes Spark filter on the list first and so build it twice.
    items = documents.select(
        *keys, F.posexplode_outer(object_items(F.col("document"), path)).alias("_at", "_item")
    ).filter(F.col("_at").isNotNull())
    row = build(F.col("_item"), F.col("_at") + 1)
    return items.select(*keys, row.alias("_row")).select(*keys, "_row.*")


def imported_prospects(documents: DataFrame) -> DataFrame:
    """One normalised row per prospect object of each document."""
    return _inlined(documents, "$.prospects", prospect_struct)


def imported_patterns(documents: DataFrame) -> DataFrame:
    return _inlined(documents, "$.patterns", pattern_struct)


def import_reports(documents: DataFrame) -> DataFrame:
    """One normalised row per document, with nested prospects and patterns and the report figures.

    The figures are computed inside the row: a document holds all of its prospects already.
    """
    doc = F.col("document")
    fields = F.col("_fields")
    plan_fields = F.coalesce(
        F.try_variant_get(doc, "$.outreach_plan", "map<string,string>"),
        F.create_map().cast("map<string,string>"),
    )

    def plan(known: Column) -> Column:
        return F.struct(
            *(
                F.when(F.map_contains_key(known, name), _text(doc, f"$.outreach_plan.{name}"))
                .otherwise(F.lit(default))
                .alias(name)
                for name, default in PLAN_DEFAULTS.items()
            )
        )

    listed = F.transform(list_items(doc, "$.limits"), lambda x: _text(x, "$"))
    prepared = compute_once(
        documents, _fields=_fields(doc), _prospects=object_items(doc, "$.prospects")
    )
    # Only what the figures need, so that a query for figures does not build whole prospects.
    figures = F.transform("_prospects", _figures)
    nested = prepared.select(
        *(c for c in documents.columns if c != "document"),
        text_field(doc, fields, "title", DOCUMENT_TITLE).alias("title"),
        *(text_field(doc, fields, name, default).alias(name) for name, default in DOCUMENT_DEFAULTS.items()),
        safe_url(text_field(doc, fields, "product_url", "")).alias("product_url"),
        F.transform("_prospects", lambda p, i: prospect_struct(p, i + 1)).alias("prospects"),
        F.transform(object_items(doc, "$.patterns"), lambda p, i: pattern_struct(p, i + 1)).alias("patterns"),
        once(plan_fields, plan).alias("outreach_plan"),
        once(
            listed, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(DEFAULT_LIMIT)))
        ).alias("limits"),
        figures.alias("_figures"),
    )
    total = F.aggregate("_figures", F.lit(0).cast("bigint"), lambda acc, p: acc + p["score"])
    mean = F.coalesce(F.bround(F.try_divide(total, F.size("_figures")), 0).cast("int"), F.lit(0))
    # Structs compare field by field: the best score, then the first in input order.
    best = F.array_max("_figures")
    return nested.select(
        *(c for c in nested.columns if c != "_figures"),
        F.size("_figures").alias("n_prospects"),
        F.size(F.filter("_figures", lambda p: p["high_intent"])).alias("n_high_intent"),
        mean.alias("average_score"),
        F.coalesce(best["name"], F.lit(NO_PROSPECT)).alias("top_name"),
        F.coalesce(best["score"], F.lit(0)).alias("top_score"),
        F.coalesce(best["text"], F.lit("")).alias("top_text"),
    )


def _figures(pair: Column, index: Column) -> Column:
    item, fields = pair["item"], pair["fields"]
    pain_signal = text_field(item, fields, "pain_signal", "")
    return F.struct(
        number_field(item, fields, "$", "score", 100).alias("score"),
        (-index).alias("before"),
        is_high_intent(text_field(item, fields, "stage", "")).alias("high_intent"),
        text_field(item, fields, "name", NO_PROSPECT).alias("name"),
        text_field(item, fields, "why_now", pain_signal).alias("text"),
    )


def write_reports(
    reports: DataFrame, path: str, fmt: str = "json", by_product: bool = True
) -> None:
    """Writes one report per product; writing a product again replaces that report only.

    Rows are shuffled by product first, so each product folder gets one file instead of one per
    task. With very many products use ``by_product=False``: plain files of many reports each.
    """
    if by_product:
        (
            reports.repartition("product_id")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("product_id")
            .format(fmt)
            .save(path)
        )
    else:
        reports.write.mode("overwrite").format(fmt).save(path)
