"""Scoring a stream of transactions against a static index, one micro-batch at a time.

Scoring holds no state. The two-stage vote reads its input twice, so it runs inside foreachBatch, where
a micro-batch is an ordinary DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knnscore.operators.ivf import Index
from knnscore.operators.vote import Probes
from knnscore.plans.scoring import score_payloads
from knnscore.sources.readers import decision_json, parse_payloads


def score_stream(lines: DataFrame, index: Index, risks: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, probes: Probes | None = None, refused: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """lines: a stream with a text column `value`. The sink gets (id, fraud_score, approved, response) and the batch's number; `refused` gets texts that aren't payloads."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            good, bad = parse_payloads(df)
            scored = score_payloads(good, index, risks, probes)
            sink(scored.withColumn("response", decision_json(F.col("approved"), F.col("fraud_score"))), number)
            if refused:
                refused(bad, number)
        finally:
            df.unpersist()

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
