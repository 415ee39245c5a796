"""Signal corpora of several source types as one table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsieve.schemas import SIGNALS


def _typed(df: DataFrame) -> DataFrame:
    """The columns of the signals table that ``df`` has, in the table's types."""
    types = {f.name: f.dataType for f in SIGNALS.fields}
    return df.select(*(F.col(c).cast(types[c]) if c in types else F.col(c) for c in df.columns))


def union_signals(corpora: Mapping[str, DataFrame]) -> DataFrame:
    """One table from a DataFrame per source type.

    Signal ids are made unique by their source type; columns a corpus lacks are NULL.
    """
    parts = [
        _typed(
            df.withColumn("source_type", F.lit(source_type)).withColumn(
                "signal_id", F.concat_ws(":", F.lit(source_type), F.col("signal_id").cast("string"))
            )
        )
        for source_type, df in corpora.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_signals(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> DataFrame:
    """Reads one folder per source type. JSON is read with the table's schema, not inferred."""
    reader = spark.read.format(fmt)
    if fmt == "json":
        reader = reader.schema(SIGNALS)
    return union_signals({kind: reader.load(path) for kind, path in paths.items()})


def write_evidence(evidence: DataFrame, path: str) -> None:
    """Writes evidence so that source-type filters prune whole folders."""
    evidence.write.mode("overwrite").partitionBy("source_type").parquet(path)
