"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are folded to lower case with single separators as white space, and become sets of hashed
character n-grams. On a bounded sample of labelled texts each n-gram gets its log-count ratio, the log of
how much more often it occurs in texts of label 1; a logistic regression with L2 penalty then
weighs the scaled features. The product of ratio and weight is one number per hash bucket, so scoring
is a table look-up per n-gram, on all texts, as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.llm.common import importable, written

SIZES = (3, 4, 5)
BITS = 20
#: Most labelled rows per class that a model is fitted on, by the order of a hash.
ROWS_PER_CLASS = 6000
#: Most features of a model, and the least log-likelihood ratio (G) between the classes that makes
#: an n-gram one: chance gives a hundred thousand n-grams about 20 at most.
FEATURES = 1 << 15
LEAST_G = 30.0
#: Characters that are hashed at a time.
CHUNK = 1 << 20


class Model(NamedTuple):
    """Weights of some hash buckets, and the log-odds without any."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between two spaces, and where each text begins and ends."""
    folded = [f" {t.lower()} " if t else "  " for t in texts]
    codes = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where((codes >= 9) & (codes <= 13), np.uint32(32), codes)
    return codes, np.cumsum([0, *map(len, folded)])


def hits(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, bucket) of the n-grams in each text, each once; only ``wanted`` buckets (a
    boolean per bucket) if given."""
    codes, bounds = characters(texts)
    found = []
    for start in range(0, len(codes), CHUNK):
        part = codes[start : start + CHUNK + max(SIZES) - 1]
        text = np.searchsorted(bounds, np.arange(start, start + len(part)), side="right") - 1
        rolling = part.copy()
        for n in range(2, max(SIZES) + 1):
            if len(part) < n:
                break
            rolling = rolling[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :]
            if n not in SIZES:
                continue
            mixed = (rolling ^ rolling >> np.uint32(15)) * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            bucket = (mixed ^ mixed >> np.uint32(13)) * np.uint32(0x297A2D39) >> np.uint32(32 - BITS)
            bucket = bucket[:CHUNK]
            inside = text[: len(bucket)] == text[n - 1 : n - 1 + len(bucket)]
            if wanted is not None:
                inside &= wanted[bucket]
            at = np.flatnonzero(inside)
            found.append(np.unique(text[at] << BITS | bucket[at]))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _slices(batch: pa.RecordBatch, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` characters."""
    start, held = 0, 0
    for i, text in enumerate(batch.column("text")):
        held += len(text.as_py() or "") + 2
        if held >= most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for rows in _slices(batch):
            label = rows.column("label").to_numpy()
            text, bucket = hits(rows.column("text").to_pylist())
            for k in (0, 1):
                counts[k] += np.bincount(bucket[label[text] == k], minlength=1 << BITS)
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, counts[0][used], counts[1][used])], names=["bucket", "n0", "n1"])


def _select(buckets) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[buckets.value] = True
        for batch in batches:
            for rows in _slices(batch):
                text, bucket = hits(rows.column("text").to_pylist(), wanted)
                column = np.searchsorted(buckets.value, bucket)
                cuts = np.searchsorted(text, np.arange(rows.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(column, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column("label"), lists], names=["label", "features"])

    return run


def _logistic(row: np.ndarray, column: np.ndarray, scale: np.ndarray, label: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and bias, by full gradients with adaptive steps (Adam)."""
    value = scale[column]
    weight = np.zeros(len(scale) + 1)
    m, v = np.zeros_like(weight), np.zeros_like(weight)
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=value * weight[column], minlength=len(label)) + weight[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * share
        gradient = np.append(np.bincount(column, weights=value * error[row], minlength=len(scale)), error.sum())
        gradient[:-1] += penalty * weight[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        weight -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return weight[:-1], float(weight[-1])


def _g(with0: Column, with1: Column, n0: int, n1: int) -> Column:
    """Log-likelihood ratio of a two by two table: texts of each class with and without an n-gram."""
    share = (with0 + with1) / (n0 + n1)
    cells = [(with0, share * n0), (with1, share * n1), (n0 - with0, (1 - share) * n0), (n1 - with1, (1 - share) * n1)]
    return 2 * sum((F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in cells), F.lit(0.0))


def fit(labelled: DataFrame, rows_per_class: int = ROWS_PER_CLASS, penalty: float = 1e-4, steps: int = 200) -> Model:
    """A model of ``labelled`` (text, label 0 or 1, order), from at most ``rows_per_class`` rows of
    each class. With rows of one class only, or none, the score is the same for every text."""
    spark = labelled.sparkSession
    importable(spark)
    sample = written(labelled.select("text", F.col("label").cast("int").alias("label")).repartition(8), "labelled")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    if not n0 or not n1:
        return Model(np.zeros(0, np.int64), np.zeros(0), prior)
    counts = sample.mapInArrow(_count, "bucket bigint, n0 bigint, n1 bigint").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = F.log(((F.col("n1") + 1) / (n1 + 2)) / ((F.col("n0") + 1) / (n0 + 2)))
    chosen = (
        counts.select("bucket", ratio.alias("ratio"), _g(F.col("n0"), F.col("n1"), n0, n1).alias("g"))
        .filter(F.col("g") >= LEAST_G)
        .orderBy(F.col("g").desc(), "bucket")
        .limit(FEATURES)
        .toPandas()
        .sort_values("bucket")
    )
    if chosen.empty:
        return Model(np.zeros(0, np.int64), np.zeros(0), prior)
    buckets, scale = chosen["bucket"].to_numpy(np.int64), chosen["ratio"].to_numpy(np.float64)
    picked = sample.mapInArrow(_select(spark.sparkContext.broadcast(buckets)), "label int, features array<int>").toArrow()
    features = picked.column("features").combine_chunks()
    row = np.repeat(np.arange(len(features)), np.diff(features.offsets.to_numpy()))
    weight, bias = _logistic(row, features.values.to_numpy(), scale, picked.column("label").to_numpy(), penalty, steps)
    return Model(buckets, weight * scale, bias)


def _score(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, weights, bias = model.value
        table = np.zeros(1 << BITS)
        table[buckets] = weights
        wanted = table != 0
        for batch in batches:
            for rows in _slices(batch):
                text, bucket = hits(rows.column("text").to_pylist(), wanted)
                z = np.bincount(text, weights=table[bucket], minlength=rows.num_rows) + bias
                kept = [(rows.column(i), n) for i, n in enumerate(rows.schema.names) if n != "text"]
                score = pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))
                yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), score], names=[*(n for _, n in kept), "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``score``: how likely label 1 is, 0 to 1. A null
    text scores as an empty one. A column named score is replaced."""
    importable(docs.sparkSession)
    docs = docs.select(*(c for c in docs.columns if c.lower() != "score"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.drop("text").dtypes), "score double"])
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(tuple(model))), schema)


def remainder(doc_id: str, of: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % of


def toxicity(
    docs: DataFrame, labels: DataFrame, holdout: tuple[int, int] = (3, 1), threshold: float = 0.7, rows_per_class: int = ROWS_PER_CLASS
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Learns from ``labels`` (doc_id, toxic) whose crc32 of the id as text leaves another remainder than
    the held-out one, at most ``rows_per_class`` per class. An id labelled more than once counts as
    toxic if any label says so; null labels and ids do not count. A null doc_id is not held out.
    Ids and labels decide which rows are learned from and are no input of a score.

    A null or empty text scores as one without n-grams. Repeated rows and equal texts score alike, a row each;
    of repeated rows of a labelled id one is learned from. Texts of any length are read whole, a
    million characters at a time. Without labels of both classes every text has one score; a table
    without rows gives none. Other columns, whatever their names, are not read.
    """
    of, out = holdout
    known = labels.filter(F.col("toxic").isNotNull() & (remainder("doc_id", of) != out)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("label = 1").orderBy(*order).limit(rows_per_class).union(known.filter("label = 0").orderBy(*order).limit(rows_per_class))
    # As many ids as the bound allows, so their table is small enough to send to the documents.
    sample = written(picked.coalesce(1), "sample")
    model = fit(docs.select("doc_id", "text").join(sample, "doc_id").dropDuplicates(["doc_id", "text"]).select("text", "label"), rows_per_class)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder("doc_id", of) == out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
