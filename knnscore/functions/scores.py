"""Scores of an evaluation: weighted errors, detection and latency on a logarithmic scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring formula.
K, BETA, EPSILON_MIN, FAILURE_CUT, CUT_SCORE = 1000.0, 300.0, 0.001, 0.15, -3000.0
T_MAX_MS, P99_MIN_MS, P99_MAX_MS = 1000.0, 1.0, 2000.0
WEIGHT_FP, WEIGHT_FN, WEIGHT_ERR = 1, 3, 5


def weighted_errors(fp: Column, fn: Column, err: Column) -> Column:
    return fp * WEIGHT_FP + fn * WEIGHT_FN + err * WEIGHT_ERR


def share(x: Column, n: Column) -> Column:
    """x / n, 0 when there is nothing."""
    return F.when(n > 0, x.cast("double") / F.when(n > 0, n)).otherwise(F.lit(0.0))


def detection_score(errors: Column, failure_rate: Column, n: Column) -> Column:
    epsilon = F.greatest(share(errors, n), F.lit(EPSILON_MIN))
    return F.when(failure_rate > FAILURE_CUT, F.lit(CUT_SCORE)).otherwise(K * F.log10(1.0 / epsilon) - BETA * F.log10(1.0 + errors.cast("double")))


def latency_score(p99: Column) -> Column:
    fast = K * F.log10(T_MAX_MS / F.greatest(p99, F.lit(P99_MIN_MS)))
    return F.when(p99 <= 0, F.lit(0.0)).when(p99 > P99_MAX_MS, F.lit(CUT_SCORE)).otherwise(fast)
