"""Votes of neighbours, decisions, and the second look at ambiguous votes."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knnscore.operators.ivf import Index
from knnscore.operators.knn import QUERY_BLOCK, knn_ivf

K = 5
#: Votes that are looked at again, and votes from which on a transaction is denied (a score of 0.6).
AMBIGUOUS, DENY_FROM = (2, 3), 3


@dataclass(frozen=True)
class Probes:
    """Clusters that the first and the second look probe."""

    fast: int
    full: int

    @staticmethod
    def of(index: Index, fast: int = 0, full: int = 0) -> Probes:
        """Given values, else the index's own and three times as many; 0 is ignored, more than all clusters are all."""
        fast_ = fast if fast > 0 else index.nprobe
        full_ = full if full > 0 else 3 * fast_
        return Probes(min(fast_, index.nlist), min(full_, index.nlist))

    @staticmethod
    def from_environment(index: Index, env: dict[str, str] | None = None) -> Probes:
        """NPROBE and FULL_NPROBE; what isn't a positive number is ignored."""
        env = os.environ if env is None else env

        def number(name: str) -> int:
            text = env.get(name, "").strip()
            return int(text) if text.isdigit() else 0

        return Probes.of(index, number("NPROBE"), number("FULL_NPROBE"))


def votes(queries: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(qid, frauds) of every query; one without neighbours has 0."""
    n = neighbours.groupBy("qid").agg(F.sum("label").cast("int").alias("_frauds")).withColumnRenamed("qid", "_q")
    return queries.select("qid").join(n, F.col("qid") == F.col("_q"), "left").select("qid", F.coalesce("_frauds", F.lit(0)).alias("frauds"))


def score(frauds: Column) -> Column:
    """Frauds of five, also where there were fewer neighbours."""
    return (frauds.cast("float") / F.lit(float(K)).cast("float")).cast("float")


def approved(frauds: Column) -> Column:
    return frauds < DENY_FROM


def decide(voted: DataFrame) -> DataFrame:
    """Adds fraud_score and approved; a vote that isn't there is approved with score 0."""
    f = F.coalesce(F.col("frauds"), F.lit(0))
    return voted.withColumns({"fraud_score": score(f), "approved": approved(f)})


def two_stage(queries: DataFrame, index: Index, probes: Probes, skip_self: bool = False, routing: str = "quantized") -> DataFrame:
    """(qid, frauds, second): the fast vote, or the full one where the fast one is ambiguous.

    The votes of a block of queries come to the driver, so that the first look is taken once; more queries are looked at lazily.
    """
    spark, most = queries.sparkSession, max(1, QUERY_BLOCK // index.dims)
    fast = votes(queries, knn_ivf(queries, index, K, probes.fast, skip_self, routing))
    first = fast.limit(most + 1).collect() if queries.limit(most + 1).count() <= most else None
    if first is not None:
        fast = spark.createDataFrame(first, fast.schema)
    again = fast.where(F.col("frauds").isin(*AMBIGUOUS)).select(F.col("qid").alias("_a"))
    asked = queries.join(again, F.col("qid") == F.col("_a"), "left_semi")
    if first is not None and not any(r.frauds in AMBIGUOUS for r in first):
        return fast.withColumn("second", F.lit(False))
    full = votes(asked, knn_ivf(asked, index, K, probes.full, skip_self, routing)).select(F.col("qid").alias("_f"), F.col("frauds").alias("_full"))
    both = fast.join(full, F.col("qid") == F.col("_f"), "left")
    return both.select("qid", F.coalesce("_full", "frauds").alias("frauds"), F.col("_full").isNotNull().alias("second"))
