"""Evaluation of decisions: rows (approved, expected_approved, ok, latency_ms); positive means denied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knnscore.functions import scores as S


def confusion(rows: DataFrame) -> DataFrame:
    """(tp, tn, fp, fn, err, n): denied frauds, approved legitimate ones, legitimate ones denied, frauds approved, failed requests."""
    ok, got, want = F.col("ok"), F.col("approved"), F.col("expected_approved")
    return rows.agg(
        F.count_if(ok & ~got & ~want).alias("tp"), F.count_if(ok & got & want).alias("tn"),
        F.count_if(ok & ~got & want).alias("fp"), F.count_if(ok & got & ~want).alias("fn"),
        F.count_if(~ok).alias("err"), F.count("*").alias("n"),
    )


def weighted(counts: DataFrame) -> DataFrame:
    errors = S.weighted_errors(F.col("fp"), F.col("fn"), F.col("err"))
    return counts.withColumns({
        "weighted_errors": errors, "epsilon": S.share(errors, F.col("n")),
        "failure_rate": S.share(F.col("fp") + F.col("fn") + F.col("err"), F.col("n")),
    })


def detection(counts: DataFrame) -> DataFrame:
    return weighted(counts).withColumn("detection_score", S.detection_score(F.col("weighted_errors"), F.col("failure_rate"), F.col("n")))


def p99(rows: DataFrame) -> DataFrame:
    return rows.agg(F.percentile("latency_ms", F.lit(0.99)).alias("p99"))


def latency(rows: DataFrame) -> DataFrame:
    return p99(rows).withColumn("p99_score", S.latency_score(F.col("p99")))


def final(rows: DataFrame) -> DataFrame:
    """One row with counts, both scores and their sum, in one pass over rows."""
    both = detection(confusion(rows)).crossJoin(latency(rows))  # one row each
    return both.withColumn("final_score", F.col("detection_score") + F.col("p99_score"))


def report(rows: DataFrame) -> DataFrame:
    """The final row as JSON with rounded figures."""
    rounded = [F.round(c, 2).alias(c) for c in ("p99", "p99_score", "detection_score", "final_score")]
    return final(rows).select(F.to_json(F.struct("tp", "tn", "fp", "fn", "err", "n", *rounded)).alias("report"))


def errors(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows that failed or differ from what was expected, with kind FP, FN or ERR, by qid."""
    kind = F.when(~F.col("ok"), "ERR").when(F.col("approved") & ~F.col("expected_approved"), "FN").when(~F.col("approved") & F.col("expected_approved"), "FP")
    found = rows.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return found if limit is None else found.orderBy("qid").limit(limit)


def dataset_stats(rows: DataFrame) -> DataFrame:
    """(total, fraud_count, legit_count, fraud_rate, legit_rate) of labelled rows."""
    n, f = F.count("*"), F.count_if(F.col("label") == 1)
    return rows.agg(n.alias("total"), f.alias("fraud_count"), (n - f).alias("legit_count"), S.share(f, n).alias("fraud_rate"), S.share(n - f, n).alias("legit_rate"))
