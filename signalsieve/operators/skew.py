"""Joins and orderings that hold when one key has a large share of all rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A heavy group beyond this many has at most one part in this many of all rows.
HEAVIEST = 1000
# Splits of 128 MB by Spark's default, so a table with fewer is small.
SMALL_SPLITS = 8
#: Tasks that a split's rows are spread over, where each row is much work.
TASKS_A_SPLIT = 16

_own_folder: list[str] = []


def salted_join(
    facts: DataFrame,
    dimension: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread_on: Sequence[str | Column] = (),
    salts: int | None = None,
) -> DataFrame:
    """Equi-join of a large, possibly skewed table with one that is narrow and near-unique on ``on``.

    By default a plain join: Spark sends the dimension to the facts while its measured size is
    under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides otherwise, where
    adaptive execution splits the partitions of hot keys.

    With ``salts``, for a hot key that has been measured, every dimension row is repeated so
    often and a fact row meets one copy, picked by a hash of ``spread_on``. The salt is a
    function of the row, so a recomputed task puts every row where it was. The copies are
    shuffled and never broadcast, as their size is no longer the dimension's.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"salting keeps only the left side whole, so it cannot do {how!r}")
    if salts is None:
        return facts.join(dimension, list(on), how)
    copies = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    salt = F.pmod(F.xxhash64(*spread_on), F.lit(salts)).cast("int")
    return facts.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


def heavy_first_join(
    facts: DataFrame, groups: DataFrame, key: str, value: str, weight: str, spread_on: str
) -> DataFrame:
    """Adds ``value`` of the row's group to ``facts``; NULL for a row without a group.

    ``groups`` has one row per key, with the number of fact rows as ``weight``. The heaviest
    groups are looked up in a broadcast table that has at most ``HEAVIEST`` rows whatever the
    data, so their fact rows never meet on one key; every other group is small by then and is
    joined by a shuffle.
    """
    heavy = groups.orderBy(F.col(weight).desc(), key).limit(HEAVIEST)
    known = facts.join(F.broadcast(heavy.select(key, F.col(value).alias("_known"))), key, "left")
    # A row that has its value gets a key of its own, which no group has.
    own = F.concat(F.lit("row "), F.col(spread_on).cast("string"))
    rest = groups.select(F.col(key).alias("_key"), F.col(value).alias("_found"))
    joined = known.withColumn(
        "_key", F.when(F.col("_known").isNull(), F.col(key)).otherwise(own)
    ).join(rest, "_key", "left")
    return joined.withColumn(value, F.coalesce("_known", "_found")).drop("_key", "_known", "_found")


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """A table of under ``SMALL_SPLITS`` splits, spread by ``key`` over as many tasks as its size asks for.

    For work that is heavy per row, such as reading texts, on a table of about a gigabyte at
    most. The number of tasks is left to adaptive execution, so no task reads a fixed share of the table. Any larger table stays exactly where it is. Filters and column
    pruning still reach the scan.
    """
    return df.repartition(key) if df.rdd.getNumPartitions() < SMALL_SPLITS else df


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """A table of narrow rows that are much work each, spread by ``key`` over ``TASKS_A_SPLIT`` tasks per split.

    A row group is read by one task, however many splits its file has, and adaptive execution joins narrow rows
    into few tasks. The number of tasks is therefore stated, so it stays; splits, and so tasks, grow with table and cluster.
    """
    return df.repartition(TASKS_A_SPLIT * max(1, df.rdd.getNumPartitions()), key)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, removed when it ends.
    """
    stated = spark.conf.get("spark.checkpoint.dir", None)
    if stated is not None:
        return stated.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


def stable(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that later reads all see the same rows.

    Every reader takes only the columns it needs, and lost executors take nothing with them.
    """
    path = f"{shared_folder(df.sparkSession)}/stable-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked_rows(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[Column],
    name: str = "rank",
    partitions: int | None = None,
) -> DataFrame:
    """Exact 1-based row number over whole groups of any size, without one task per group.

    A plain window sends each group to one task. Here the rows are range-partitioned on group
    and order, so a hot group spans many tasks; each task numbers its own rows and a small
    table of per-task row counts turns those into group-wide numbers. ``order_by`` has to be a
    total order within a group. The ordered rows are written out once, because both the counts
    and the final numbers must come from the very same placement.
    """
    keys = list(partition_by)
    ordering = [*(F.col(k).asc() for k in keys), *order_by]
    ranged = (
        df.repartitionByRange(partitions, *ordering) if partitions else df.repartitionByRange(*ordering)
    )
    placed = stable(
        ranged.sortWithinPartitions(*ordering).withColumn("_slot", F.monotonically_increasing_id())
    ).withColumn("_task", F.shiftright("_slot", 33))
    per_task = placed.groupBy(*keys, "_task").agg(
        F.count("*").alias("_rows"), F.min("_slot").alias("_first")
    )
    # At most one row per task and group: this window sees no more rows than there are tasks.
    earlier = (
        Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_task.select(
        *keys, "_task", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        placed.join(offsets, [*keys, "_task"])
        .withColumn(name, F.col("_before") + F.col("_slot") - F.col("_first") + 1)
        .drop("_slot", "_task", "_first", "_before")
    )
