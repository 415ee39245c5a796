"""Report documents as they arrive: files are taken in once, in batches, broken ones beside the others.

Each micro-batch is written to a folder of its own number, which a batch that runs again after a failure
replaces. The checkpoint says which files a batch has, so what is read back holds every document once,
wherever a job broke off.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalsieve.operators.columns import compute_once
from signalsieve.sources.reports import parse_documents

_TAKEN = "document_id string, body string, reason string, batch bigint, kind string"


def arriving_documents(spark: SparkSession, path: str, one_per_line: bool = False, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (document_id, body): one document per file, or one per line of JSON-lines files.

    A line's id is its file and a digest of the line, so it does not depend on how files are split; equal lines
    of a file have one id. Blank lines are no documents, nor are files without a byte.
    """
    reader = spark.readStream.format("text").option("wholetext", not one_per_line).option("maxFilesPerTrigger", files_per_batch)
    place, body = F.col("_metadata.file_path"), F.col("value").alias("body")
    lines = reader.load(path)
    if one_per_line:
        return lines.filter(F.trim("value") != "").select(F.concat_ws("#", place, F.sha2("value", 256)).alias("document_id"), body)
    return lines.select(place.alias("document_id"), body)


def judged_documents(documents: DataFrame) -> DataFrame:
    """Documents with ``reason`` (null for a JSON object) and ``kind``, good or quarantine; each is parsed once."""
    raw = F.col("body")
    parsed = F.try_parse_json(raw).isNotNull()
    reason = F.when(~parsed | raw.isNull(), F.lit("not_json")).when(~raw.rlike(r"^\s*\{"), F.lit("not_an_object"))
    judged = compute_once(documents, reason=reason)
    return judged.withColumn("kind", F.when(F.col("reason").isNull(), F.lit("good")).otherwise(F.lit("quarantine")))


def take_batch(documents: DataFrame, batch: int, path: str) -> None:
    """Writes one batch of documents; the same batch again replaces it."""
    judged_documents(documents).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={batch}")


def take_in(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes in all documents of a stream that are available now."""
    return (
        documents.writeStream.foreachBatch(lambda rows, batch: take_batch(rows, batch, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def taken_in(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What :func:`take_in` wrote so far: good documents (document_id and VARIANT ``document``, with their
    batch) and the quarantine (document_id, body, reason, batch). Folders of the other kind are not read."""
    try:
        rows = spark.read.schema(_TAKEN).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _TAKEN)
    good, _ = parse_documents(rows.filter("kind = 'good'").drop("kind", "reason"))
    return good, rows.filter("kind = 'quarantine'").drop("kind")
