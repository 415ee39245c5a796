"""Tables of one mergeable row per key, kept up to date by replacing the files of touched buckets.

Keys are dealt to buckets by a hash. A merge reads the buckets that new rows fall into, folds old and new
rows of a key into one, and writes these buckets under a new name; all others stay the very same files.
What is current is said by small commit tables, one per batch and written last: a merge that broke
off leaves files nobody reads, and a batch that is in already changes nothing when it comes again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsieve.operators.skew import stable

BUCKETS = 64
#: Name of the folders of buckets; no column of a table may have it.
FOLDER = "keyed_bucket"
_COMMITS = "bucket int, folder string, buckets int, batch bigint"

Fold = Callable[[DataFrame], DataFrame]


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """All commits of the table: bucket, folder, number of buckets and batch. Few rows: one per batch and bucket."""
    try:
        return spark.read.schema(_COMMITS).parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMITS)


def current_folders(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder that holds each bucket now; as many entries as there are buckets."""
    latest = commits(spark, path).filter("bucket >= 0").groupBy("bucket").agg(F.max_by("folder", "batch").alias("folder")).collect()
    return {r["bucket"]: r["folder"] for r in latest}


def read_keyed(spark: SparkSession, path: str, schema, only: Sequence[int] | None = None) -> DataFrame:
    """The table's rows, of all buckets or ``only`` some."""
    folders = current_folders(spark, path)
    wanted = [f"{path}/data/{f}/{FOLDER}={b}" for b, f in sorted(folders.items()) if only is None or b in set(only)]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def merge_keyed(path: str, rows: DataFrame, keys: Sequence[str], fold: Fold, batch: int, buckets: int = BUCKETS) -> list[int]:
    """Folds ``rows`` into the table at ``path`` as ``batch`` and returns the buckets that were rewritten.

    ``fold`` makes one row per key of rows with ``rows``' columns, and must not depend on their order or on
    which were folded before. Batches have ascending numbers; one that is not above the last is in
    already and is skipped, so a restarted job may send it again.
    """
    spark = rows.sparkSession
    done = commits(spark, path).agg(F.max("batch").alias("last"), F.max("buckets").alias("buckets")).first()
    if done["buckets"] not in (None, buckets):
        raise ValueError(f"the table has {done['buckets']} buckets, not {buckets}")
    if done["last"] is not None and batch <= done["last"]:
        return []
    new = stable(fold(rows).withColumn("_bucket", bucket_of(keys, buckets)))
    # At most as many rows as there are buckets.
    touched = sorted(r["_bucket"] for r in new.select("_bucket").distinct().collect())
    new = new.drop("_bucket")
    folder = f"batch-{batch}-{uuid.uuid4().hex}"
    if touched:
        old = read_keyed(spark, path, new.schema, touched)
        merged = fold(old.unionByName(new)).withColumn(FOLDER, bucket_of(keys, buckets))
        merged.repartition(min(buckets, len(touched)), FOLDER).write.partitionBy(FOLDER).parquet(f"{path}/data/{folder}")
    # A batch without rows is committed too, under no bucket.
    entries = [(b, folder, buckets, batch) for b in touched or [-1]]
    spark.createDataFrame(entries, _COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return touched
