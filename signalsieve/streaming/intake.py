"""The row-local part of qualification on a stream of signals.

Policy, classification and redaction keep no state, so the batch operators run on a streaming
DataFrame as they are. Deduplication, scoring and ranking look at whole products and run as batch
jobs over the evidence written here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from signalsieve.config import SEED_LEXICON, Phrase
from signalsieve.operators.evidence import label_evidence
from signalsieve.operators.matching import classify
from signalsieve.operators.policy import apply_source_policy, exclude_sensitive, redact


def evidence_stream(
    signals: DataFrame,
    phrases: Sequence[Phrase] = SEED_LEXICON,
    sensitive_terms: Sequence[str] = (),
    redacted: Sequence[str] = ("text",),
) -> DataFrame:
    """Allowed, classified and redacted signals; works on batch and streaming DataFrames."""
    allowed = exclude_sensitive(apply_source_policy(signals), sensitive_terms)
    return redact(label_evidence(classify(allowed, phrases)), redacted)


def append_evidence(evidence: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all evidence available now to a Parquet folder, each signal exactly once.

    ``checkpoint`` has to be on storage that outlives the cluster, like ``path`` itself.
    """
    return (
        evidence.writeStream.format("parquet")
        .partitionBy("source_type")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
