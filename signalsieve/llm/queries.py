"""The registered queries of this package: thin uses of its operators over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsieve.llm.bpe import encode_documents
from signalsieve.llm.common import documents, full_text, let, words
from signalsieve.llm.exact_dedup import group_copies
from signalsieve.llm.fill_middle import fill_in_middle, frame_digests
from signalsieve.llm.language_crf import language_ids
from signalsieve.llm.licenses import scan
from signalsieve.llm.mixing import mix
from signalsieve.llm.periodic_runs import periodic_runs
from signalsieve.llm.quality import judge
from signalsieve.llm.sentence_pieces import encode_pieces
from signalsieve.llm.separator_scan import token_counts
from signalsieve.llm.simhash_dedup import hex_print, near_duplicates
from signalsieve.llm.token_files import read_token_files, write_token_files
from signalsieve.llm.toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic each document is."""
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    groups = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return groups.select("doc_id", hex_print().alias("fingerprint"), "component_id")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document in token files written and read back."""
    path = write_token_files(documents(spark, sf_dir), vocabulary(), end=2)
    return read_token_files(spark, path, digest=True)


def op4_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document."""
    return judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The text of a public tokenizer's file."""
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def digests(encoded: DataFrame, between: str = " ") -> DataFrame:
    """Counts and digests of encoded documents."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), between), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document encoded and decoded."""
    return digests(encode_documents(documents(spark, sf_dir).select("doc_id", "text"), vocabulary()))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of each document."""
    return group_copies(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, counted in flat token files."""
    spec = vocabulary()
    end = json.loads(spec)["added_tokens"][-1]["id"]
    return token_counts(documents(spark, sf_dir), spec, end)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document."""
    return language_ids(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in each document."""
    starts = F.transform("base_starts", lambda x: x["start"])
    return scan(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        F.size("base_starts").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources takes."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document transformed to fill in its middle, and rebuilt."""
    return frame_digests(fill_in_middle(documents(spark, sf_dir)))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) of which every tenth, by a checksum of the id, repeats its words from some
    place on; a document without an id is left as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(parts: Column) -> Column:
        n = F.size(parts)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        moved = F.transform(parts, lambda w, i: F.when(i >= a, F.get(parts, (a + (i - a) % p).cast("int"))).otherwise(w))
        return F.when(n > 0, F.array_join(moved, " "))

    planted = let(words(full_text()), repeated)
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in each document."""
    found = periodic_runs(with_planted_period(documents(spark, sf_dir)))

    def before(a: Column, b: Column) -> Column:
        by_exponent = b["length"] * a["period"] - a["length"] * b["period"]
        in_order = [by_exponent, a["start"] - b["start"], a["period"] - b["period"]]
        return F.coalesce(*(F.when(x != 0, F.signum(x).cast("int")) for x in in_order), F.lit(0))

    best = F.get(F.array_sort("runs", before), 0)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def piece_vocabulary(name: str = "piece_bpe_32k.model") -> bytes:
    """The bytes of a public SentencePiece model."""
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document encoded and decoded by SentencePiece."""
    return digests(encode_pieces(documents(spark, sf_dir), piece_vocabulary()), ",")


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_toxicity, op2_simhash_near_dedup, op3_token_files, op4_quality_outliers, op5_bpe, op6_exact_dedup, op7_token_counts,
        op8_language_id, op9_license_scan, op10_source_mix, op11_fill_middle, op12_periodic_runs, op13_sentence_pieces,
    )
    return {f.__name__: f for f in operators}
