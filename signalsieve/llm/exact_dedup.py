"""Exact deduplication as a stateful stream.

Documents arrive as (digest, identifier, locator) rows. A streaming aggregation keeps, without
expiry, one state row per digest in RocksDB: the largest identifier seen, where its content lies
(file and row) and the number of hits. State lives on local disks, is saved to the checkpoint
folder with every micro-batch and grows by a few dozen bytes per distinct text, whatever the texts'
lengths. Digests with more than one hit are checked on the full bytes, which are fetched by
locator. All of it is built-in Spark, without Python in the tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.llm.common import LOCATOR, full_text, located, new_folder, with_locator, written

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # A store is closed when its task is done: batches are few and large, and an open store holds
    # some MB of disk whatever its size.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}

def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def keyed_state(arrivals: DataFrame, folder: str) -> DataFrame:
    """Runs the stream ``arrivals`` (digest, doc_id, _file, _row) to its end and returns the state.

    One row per digest: digest, keep (doc_id, _file, _row of the largest id), group_size. A run that
    was interrupted goes on from ``folder`` if called again with the same source; later arrivals
    meet the state of earlier ones.
    """
    spark = arrivals.sparkSession
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        query = (
            arrivals.groupBy("digest")
            .agg(F.max(F.struct("doc_id", *LOCATOR)).alias("keep"), F.count("*").alias("group_size"))
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", folder)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(folder)
    keep, count = state.schema["value"].dataType.names
    return state.select("key.digest", F.col(f"value.{keep}").alias("keep"), F.col(f"value.{count}").alias("group_size"))


def group_copies(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its group of equal texts.

    Returns doc_id, _file, _row, digest, keep_id, group_size, kept. A null text equals the empty
    text. Of equal texts the largest doc_id stays; of rows that share that id too, the one that
    lies last. Null ids are the smallest. Texts are equal only if all bytes are: should
    a digest stand for several texts, its rows are grouped anew by the texts themselves. Other
    columns are not read; an empty table gives an empty result.
    """
    return _grouped(with_locator(docs.select("doc_id", "text")), digest, files_per_batch)


def _grouped(docs: DataFrame, digest: Callable[[Column], Column], files_per_batch: int) -> DataFrame:
    """:func:`group_copies` of rows that have their locators."""
    spark = docs.sparkSession
    arrivals = written(
        docs.select("doc_id", digest(full_text()).alias("digest"), *LOCATOR), "arrivals"
    )
    if arrivals.isEmpty():
        return arrivals.select(
            "doc_id", *LOCATOR, "digest", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept")
        )
    folder = arrivals.inputFiles()[0].rpartition("/")[0]
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    state = written(keyed_state(stream, new_folder(spark, "dedup-state")), "dedup-groups")

    # Full bytes of every hit. Locators are unique, so a digest with a third of all rows spreads
    # evenly; then each task passes on one row per text at most.
    hits = arrivals.join(state.filter("group_size > 1").select("digest"), "digest")
    contents = hits.join(docs.select(full_text().alias("text"), *LOCATOR), LOCATOR)
    texts = contents.groupBy("text").agg(
        F.min("digest").alias("digest"), F.max(F.struct("doc_id", *LOCATOR)).alias("keep"), F.count("*").alias("group_size")
    )
    shared = written(texts.groupBy("digest").count().filter("count > 1").select("digest"), "dedup-collisions")

    def decided(rows: DataFrame) -> DataFrame:
        same = (F.col("_file") == F.col("keep._file")) & (F.col("_row") == F.col("keep._row"))
        return rows.select(
            "doc_id", *LOCATOR, "digest", F.col("keep.doc_id").alias("keep_id"), "group_size", same.alias("kept")
        )

    if shared.isEmpty():
        return decided(arrivals.join(state, "digest"))
    by_text = contents.join(shared, "digest").join(
        texts.select("text", "keep", "group_size"), "text"
    )
    by_digest = arrivals.join(state, "digest").join(shared, "digest", "left_anti")
    return decided(by_digest).unionByName(decided(by_text))


def without_copies(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000
) -> DataFrame:
    """``docs`` without all but one of each group of equal texts, in its own columns."""
    placed, narrow, columns = located(docs, "doc_id", "text")
    dropped = _grouped(narrow, digest, files_per_batch).filter(~F.col("kept"))
    return placed.join(dropped.select(*LOCATOR).toDF(*columns), columns, "left_anti").select(*docs.columns)
