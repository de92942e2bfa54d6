"""The registered queries over the driver's tables, and their SQL.

Vectors are `embeddings` (64 dimensions); a label of 5 or more counts as fraud. Search queries are the
rows whose vec_id is divisible by 50, against all other rows. Transactions come from `events`.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knnscore.functions import features as X
from knnscore.functions import vectors as V
from knnscore.operators import evaluate, ivf, kmeans, knn, transactions, vote
from knnscore.plans import scoring
from knnscore.schema import PAYLOAD
from knnscore.sources.readers import decision_json, encode_label, with_risk

#: These embeddings hardly form clusters: a recall of 0.9 takes most of them (figures in the README).
DIMS, NLIST, NPROBE, FULL_NPROBE, ROUNDS = 64, 8, 7, 8, 2


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, q, label 0/1, digit)"""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", V.quantize_vector(F.col("embedding")).alias("q"), F.when(F.col("label") >= 5, 1).otherwise(0).alias("label"), F.col("label").alias("digit"))


def asked(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "q", F.col("label").alias("own"))


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.from_events(spark.read.parquet(f"{sf}/events.parquet"))


def risks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(transactions.MCC_RISK.items()), "mcc string, risk float")


def with_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_risk(payloads(spark, sf), risks(spark)).withColumnRenamed("mcc_risk", "_risk")
    return X.add_features(rows, F.col("_risk")).select("event_id", *X.NAMES)


def quantize_embeddings(spark, sf):
    return vectors(spark, sf).select("vec_id", F.posexplode("q").alias("dim", "q"))


def _features(names, spark, sf):
    return with_features(spark, sf).select("event_id", *names)


def feature_vector_full(spark, sf):
    return with_features(spark, sf).select("event_id", *(V.quantize(F.col(n)).alias(n) for n in X.NAMES))


def mcc_risk_lookup(spark, sf):
    rows = with_risk(payloads(spark, sf), risks(spark))
    return rows.select("event_id", F.col("merchant.mcc").alias("mcc"), F.coalesce("mcc_risk", F.lit(X.DEFAULT_RISK).cast("float")).alias("mcc_risk"))


def unknown_merchant_flag(spark, sf):
    return payloads(spark, sf).select("event_id", (~F.array_contains("customer.known_merchants", F.col("merchant.id"))).cast("int").alias("unknown_merchant"))


def reference_label_encode(spark, sf):
    text = F.when(F.col("event_type") == "error", "fraud").otherwise(F.col("event_type"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", encode_label(text).alias("label"))


def l2sq_pairs(spark, sf):
    v = vectors(spark, sf)
    pairs = knn._pairs(asked(v), v, DIMS, False)
    return pairs.select("qid", "vec_id", "d")


def _knn(k, strategy, spark, sf):
    v = vectors(spark, sf)
    return knn.knn(asked(v), v, k, DIMS, strategy, skip_self=True).select("qid", "vec_id", "label", "d", "rank")


def exact_votes(spark, sf):
    v = vectors(spark, sf)
    q = asked(v)
    return vote.votes(q, knn.knn(q, v, vote.K, DIMS, "arrow", skip_self=True))


def fraud_score_exact(spark, sf):
    return exact_votes(spark, sf).select("qid", "frauds", vote.score(F.col("frauds")).alias("fraud_score"))


def fraud_decision_exact(spark, sf):
    return vote.decide(exact_votes(spark, sf)).select("qid", "frauds", "approved")


def decision_json_rows(spark, sf):
    """The response as JSON, parsed back."""
    d = vote.decide(exact_votes(spark, sf)).select("qid", decision_json(F.col("approved"), F.col("fraud_score")).alias("response"))
    parsed = F.from_json("response", "approved boolean, fraud_score float")
    return d.select("qid", parsed.alias("p")).select("qid", "p.approved", "p.fraud_score")


def label_accuracy(spark, sf):
    """How often the majority of five neighbours has the query's own class, over the query set."""
    v = vectors(spark, sf)
    q = asked(v)
    own = q.select(F.col("qid").alias("_q"), "own")
    voted = exact_votes(spark, sf).join(own, F.col("qid") == F.col("_q"))
    hit = (F.col("frauds") >= vote.DENY_FROM) == (F.col("own") == 1)
    return voted.agg(F.count("*").alias("n"), F.count_if(hit).alias("n_right"))


def centroids(spark, sf, rounds=ROUNDS):
    v = vectors(spark, sf).select("vec_id", "q", "label")
    return v, kmeans.iterate_sql(v, kmeans.seeds(v, NLIST), DIMS, rounds)


def index(spark, sf) -> ivf.Index:
    v = vectors(spark, sf).select("vec_id", "q", "label")
    c, _ = kmeans.fit(v, NLIST, DIMS, ROUNDS)
    placed = kmeans.assign(v, c).select("cluster_id", "vec_id", "q", "label")
    return ivf.Index(placed, kmeans.table_of(spark, c), DIMS, NLIST, NPROBE)


def nearest_centroids(spark, sf):
    v = vectors(spark, sf)
    near = knn.nearest_clusters(asked(v), index(spark, sf).centroids, 3, DIMS)
    return near.select("qid", "cluster_id", "cd", "probe")


def kmeans_assign(spark, sf):
    v, c = centroids(spark, sf, 0)
    return kmeans.assign_sql(v, c, DIMS).select("vec_id", "cluster_id", "d")


def _exploded(c):
    return c.select("cluster_id", F.posexplode("centroid").alias("dim", "value"))


def kmeans_update(spark, sf):
    return _exploded(centroids(spark, sf, 1)[1])


def kmeans_2iter(spark, sf):
    """By the production path; the SQL is two rounds of relational algebra."""
    v = vectors(spark, sf).select("vec_id", "q", "label")
    return _exploded(kmeans.table_of(spark, kmeans.fit(v, NLIST, DIMS, 2)[0]))


def kmeans_inertia(spark, sf):
    v = vectors(spark, sf).select("vec_id", "q", "label")
    return kmeans.inertia(kmeans.assign(v, kmeans.fit(v, NLIST, DIMS, ROUNDS)[0]))


def cluster_histogram(spark, sf):
    return ivf.histogram(index(spark, sf).vectors)


def cluster_padded_sizes(spark, sf):
    return ivf.padded(ivf.histogram(index(spark, sf).vectors))


def cluster_offsets(spark, sf):
    return ivf.offsets(ivf.histogram(index(spark, sf).vectors))


def cluster_ranges(spark, sf):
    wanted = spark.range(0, NLIST + 2).select(F.col("id").cast("int").alias("cluster_id"))
    blocks = (F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("first_block", "end_block"))
    return ivf.cluster_range(cluster_offsets(spark, sf), wanted).select("cluster_id", *blocks)


def _ivf(nprobe, spark, sf):
    v = vectors(spark, sf)
    return knn.knn_ivf(asked(v), index(spark, sf), vote.K, nprobe, skip_self=True).select("qid", "vec_id", "label", "d", "rank")


def two_stage(spark, sf):
    i = index(spark, sf)
    return vote.two_stage(asked(vectors(spark, sf)), i, vote.Probes.of(i, NPROBE, FULL_NPROBE), skip_self=True)


def fraud_score_two_stage(spark, sf):
    return vote.decide(two_stage(spark, sf)).select("qid", "frauds", "second", "approved")


def ambiguous_queries(spark, sf):
    return two_stage(spark, sf).where("second").select("qid")


def recall_at_5(spark, sf):
    v = vectors(spark, sf)
    exact = knn.knn(asked(v), v, vote.K, DIMS, skip_self=True)
    return knn.recall(_ivf(NPROBE, spark, sf), exact).select("n_exact", "n_hits")


def nprobe_sweep(spark, sf):
    v, i = vectors(spark, sf), index(spark, sf)
    exact, out = knn.knn(asked(v), v, vote.K, DIMS, skip_self=True), None
    for n in (1, 2, 4, 8):
        row = knn.recall(knn.knn_ivf(asked(v), i, vote.K, n, skip_self=True), exact).select(F.lit(n).alias("nprobe"), "n_exact", "n_hits")
        out = row if out is None else out.unionByName(row)
    return out


def outcomes(spark, sf):
    """(qid, approved, expected_approved, ok, latency_ms) of every event: approved below a value, expected by its type, errors by its number."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(
        F.col("event_id").alias("qid"), (F.col("value") < 450).alias("approved"), (F.col("event_type") != "error").alias("expected_approved"),
        (F.col("event_id") % 997 != 0).alias("ok"), (F.col("value") / 10).alias("latency_ms"),
    )


def confusion_matrix(spark, sf):
    return evaluate.confusion(outcomes(spark, sf))


def weighted_error(spark, sf):
    return evaluate.weighted(evaluate.confusion(outcomes(spark, sf))).select("weighted_errors", "epsilon", "failure_rate")


def detection_score(spark, sf):
    """Per event type, so that both branches of the score occur."""
    rows = outcomes(spark, sf).join(spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("_e"), "event_type"), F.col("qid") == F.col("_e"))
    ok, got, want = F.col("ok"), F.col("approved"), F.col("expected_approved")
    counts = rows.groupBy("event_type").agg(F.count_if(ok & ~got & want).alias("fp"), F.count_if(ok & got & ~want).alias("fn"), F.count_if(~ok).alias("err"), F.count("*").alias("n"))
    return evaluate.detection(counts).select("event_type", F.round("detection_score", 6).alias("detection_score"))


def p99_value(spark, sf):
    return evaluate.p99(outcomes(spark, sf))


def latency_score(spark, sf):
    return evaluate.latency(outcomes(spark, sf)).select(F.round("p99_score", 6).alias("p99_score"))


def final_score(spark, sf):
    return evaluate.final(outcomes(spark, sf)).select("n", F.round("final_score", 6).alias("final_score"))


def error_dump(spark, sf):
    return evaluate.errors(outcomes(spark, sf)).select("qid", "kind", "approved", "expected_approved")


def dataset_stats(spark, sf):
    return evaluate.dataset_stats(vectors(spark, sf))


def index_validate_sample(spark, sf):
    return scoring.validate(index(spark, sf))


def payload_json_decode(spark, sf):
    """Payloads written as JSON and read back: fields of every level."""
    names = [f.name for f in PAYLOAD]
    text = payloads(spark, sf).select("event_id", F.to_json(F.struct(*names)).alias("value"))
    back = text.select("event_id", F.from_json("value", PAYLOAD).alias("p"))
    return back.select(
        "event_id", "p.id", "p.transaction.installments", "p.customer.tx_count_24h", F.size("p.customer.known_merchants").alias("n_known"),
        F.col("p.merchant.mcc").alias("mcc"), "p.terminal.is_online", F.col("p.transaction.amount").alias("amount"), F.col("p.last_transaction.timestamp").alias("last_timestamp"),
    )


def purchase_decisions(spark, sf):
    """The query set (purchases whose event_id is divisible by 50) scored against all events that aren't purchases (fraud: errors), by exact five nearest feature vectors."""
    f = with_features(spark, sf).select("event_id", F.array(*(V.quantize(F.col(n)) for n in X.NAMES)).alias("q"))
    kind = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("_e"), "event_type")
    rows = f.join(kind, F.col("event_id") == F.col("_e"))
    refs = rows.where("event_type <> 'purchase'").select(F.col("event_id").alias("vec_id"), "q", encode_label(F.when(F.col("event_type") == "error", "fraud")).alias("label"))
    q = rows.where("event_type = 'purchase' and event_id % 50 = 0").select(F.col("event_id").alias("qid"), "q")
    return vote.decide(vote.votes(q, knn.knn(q, refs, vote.K, len(X.NAMES)))).select("qid", "frauds", "approved")


def ml_kmeans_index(spark, sf):
    placed, _ = kmeans.fit_ml(vectors(spark, sf), NLIST, 10)
    return ivf.histogram(placed)


# SQL for DuckDB


def _sum(terms):
    return " + ".join(terms)


def _d(a: str, b: str, dims: int = DIMS) -> str:
    return _sum(f"({a}[{i}] - {b}[{i}])::BIGINT * ({a}[{i}] - {b}[{i}])" for i in range(1, dims + 1))


def _q(x: str) -> str:
    return f"greatest(-32768, least(32767, round(({x})::FLOAT * 10000::FLOAT)))::INT"


E = f"""v AS MATERIALIZED (SELECT vec_id, [{', '.join(_q(f'embedding[{i}]') for i in range(1, DIMS + 1))}] AS q,
  CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label FROM embeddings),
qs AS (SELECT vec_id AS qid, q, label AS own FROM v WHERE vec_id % 50 = 0)"""
PAIRS = f"pairs AS MATERIALIZED (SELECT qid, vec_id, v.label, {_d('qs.q', 'v.q')} AS d FROM qs, v)"


def _top(k: int, source: str = "pairs") -> str:
    return f"""SELECT * FROM (SELECT qid, vec_id, label, d, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id)::INT AS rank
  FROM {source} WHERE qid <> vec_id) WHERE rank <= {k}"""


VOTES = f"near AS ({_top(5)}), votes AS (SELECT qid, sum(label)::INT AS frauds FROM near GROUP BY qid)"
SEEDS = f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY md5(vec_id::VARCHAR)) - 1)::INT AS cluster_id, q AS c FROM v
  QUALIFY cluster_id < {NLIST})"""


def _assign(n: int) -> str:
    return f"""a{n} AS MATERIALIZED (SELECT vec_id, q, label, cluster_id, d FROM (
  SELECT vec_id, q, label, cluster_id, {_d('q', 'c')} AS d FROM v, c{n})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_id) = 1)"""


def _update(n: int) -> str:
    means = ", ".join(f"round(sum(q[{i}])::DOUBLE / count(*))::INT" for i in range(1, DIMS + 1))
    return f"""c{n + 1} AS MATERIALIZED (SELECT c{n}.cluster_id, coalesce(m.c, c{n}.c) AS c FROM c{n}
  LEFT JOIN (SELECT cluster_id, [{means}] AS c FROM a{n} GROUP BY cluster_id) m USING (cluster_id))"""


KMEANS = f"{E}, {SEEDS}, {_assign(0)}, {_update(0)}, {_assign(1)}, {_update(1)}, {_assign(2)}"
SIZES = "sizes AS (SELECT cluster_id, count(*) AS size FROM a2 GROUP BY cluster_id)"
OFFSETS = """o AS (SELECT cluster_id, size, (ceil(size / 8.0))::BIGINT AS blocks,
  coalesce(sum((ceil(size / 8.0))::BIGINT) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_block FROM sizes)"""
PROBES = f"""probes AS MATERIALIZED (SELECT qid, q, own, cluster_id, cd, row_number() OVER (PARTITION BY qid ORDER BY cd, cluster_id)::INT AS probe
  FROM (SELECT qid, q, own, cluster_id, {_d('q', 'c')} AS cd FROM qs, c2))"""


def _probed(name: str, n: int) -> str:
    return f"{name} AS (SELECT qid, vec_id, a2.label, {_d('probes.q', 'a2.q')} AS d FROM probes JOIN a2 USING (cluster_id) WHERE probe <= {n})"


def _voted(name: str, source: str) -> str:
    return f"{name} AS (SELECT qs.qid, coalesce(sum(t.label), 0)::INT AS frauds FROM qs LEFT JOIN ({_top(5, source)}) t ON t.qid = qs.qid GROUP BY qs.qid)"


TWO = f"""{KMEANS}, {PROBES}, {_probed('p_fast', NPROBE)}, {_probed('p_full', FULL_NPROBE)}, {_voted('fast', 'p_fast')}, {_voted('full_', 'p_full')},
two AS (SELECT fast.qid, CASE WHEN fast.frauds IN (2, 3) THEN full_.frauds ELSE fast.frauds END AS frauds, fast.frauds IN (2, 3) AS second FROM fast JOIN full_ USING (qid))"""


def _hits(n: int) -> str:
    return f"""(SELECT count(*) AS n_exact, sum(CASE WHEN t.qid IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_hits FROM ({_top(5)}) e
  LEFT JOIN ({_top(5, f'p{n}')}) t ON t.qid = e.qid AND t.vec_id = e.vec_id)"""


_MCC = ", ".join(f"'{m}'" for m in [*transactions.MCC_RISK, *transactions.UNKNOWN_MCC])
_RISK = " ".join(f"WHEN '{m}' THEN {r}" for m, r in transactions.MCC_RISK.items())
TX = f"""tx AS MATERIALIZED (SELECT *, (value * 20)::FLOAT AS amount, (event_id % 12 + 1)::INT AS installments,
  lag(ts) OVER o AS last_ts, (count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {transactions.DAY_US} PRECEDING AND CURRENT ROW))::INT AS in_day,
  (floor(sum(round(value * 100)::BIGINT) OVER u / count(*) OVER u) / 100)::FLOAT AS mean,
  'MERC-' || lpad((event_id % {transactions.MERCHANTS})::VARCHAR, 3, '0') AS merchant_id,
  [{_MCC}][(event_id % {len(transactions.MCC_RISK) + 2} + 1)::INT] AS mcc, ((event_id % 500) * 25)::FLOAT AS merchant_avg,
  coalesce((props->>'$.k')::INT, 0) AS k, (event_id % 1500)::FLOAT AS km_home, ((event_id % 2000) * 0.75)::FLOAT AS km_last,
  row_number() OVER (PARTITION BY user_id, event_id % {transactions.MERCHANTS} ORDER BY ts, event_id) = 1 AS unknown
  FROM events WINDOW u AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _scaled(x: str, most: float) -> str:
    return f"greatest(0::FLOAT, least(1::FLOAT, (({x})::FLOAT / {most}::FLOAT)::FLOAT))"


_SECONDS = "epoch(date_trunc('second', {}))::BIGINT"
_MINUTES = f"(({_SECONDS.format('ts')} - {_SECONDS.format('last_ts')}) // 60)"
FEATURE_SQL = {
    "amount": _scaled("amount", 10000), "installments": _scaled("installments", 12),
    "amount_vs_avg": f"CASE WHEN mean = 0 THEN CASE WHEN amount > 0 THEN 1::FLOAT ELSE 0::FLOAT END ELSE {_scaled('(amount / mean)::FLOAT', 10)} END",
    "hour_of_day": "(hour(ts)::FLOAT / 23::FLOAT)::FLOAT", "day_of_week": "((isodow(ts) - 1)::FLOAT / 6::FLOAT)::FLOAT",
    "minutes_since_last_tx": f"CASE WHEN last_ts IS NULL THEN -1::FLOAT ELSE {_scaled(_MINUTES, 1440)} END",
    "km_from_last_tx": f"CASE WHEN last_ts IS NULL THEN -1::FLOAT ELSE {_scaled('km_last', 1000)} END",
    "km_from_home": _scaled("km_home", 1000), "tx_count_24h": _scaled("in_day", 20),
    "is_online": "(k % 2 = 1)::INT::FLOAT", "card_present": "(k % 3 = 0)::INT::FLOAT", "unknown_merchant": "unknown::INT::FLOAT",
    "mcc_risk": f"(CASE mcc {_RISK} ELSE 0.5 END)::FLOAT", "merchant_avg_amount": _scaled("merchant_avg", 10000),
}


def _select(names) -> str:
    return f"WITH {TX} SELECT event_id, {', '.join(f'{FEATURE_SQL[n]} AS {n}' for n in names)} FROM tx"


OUT = """out_ AS (SELECT event_id AS qid, event_type, value < 450 AS approved, event_type <> 'error' AS expected_approved, event_id % 997 <> 0 AS ok, value / 10 AS latency_ms FROM events)"""
COUNTS = """count(*) FILTER (WHERE ok AND NOT approved AND NOT expected_approved) AS tp, count(*) FILTER (WHERE ok AND approved AND expected_approved) AS tn,
  count(*) FILTER (WHERE ok AND NOT approved AND expected_approved) AS fp, count(*) FILTER (WHERE ok AND approved AND NOT expected_approved) AS fn,
  count(*) FILTER (WHERE NOT ok) AS err, count(*) AS n"""
_DET = """CASE WHEN (fp + fn + err)::DOUBLE / n > 0.15 THEN -3000.0
  ELSE 1000.0 * log10(1.0 / greatest((fp + 3 * fn + 5 * err)::DOUBLE / n, 0.001)) - 300.0 * log10(1.0 + (fp + 3 * fn + 5 * err)::DOUBLE) END"""
_LAT = "CASE WHEN p99 <= 0 THEN 0.0 WHEN p99 > 2000 THEN -3000.0 ELSE 1000.0 * log10(1000.0 / greatest(p99, 1.0)) END"
_FULL_Q = "[" + ", ".join(_q(x) for x in FEATURE_SQL.values()) + "]"

SCALAR = ("amount", "installments", "amount_vs_avg", "km_from_home", "is_online", "card_present", "merchant_avg_amount")
TIME = ("hour_of_day", "day_of_week")
HISTORY = ("minutes_since_last_tx", "km_from_last_tx", "tx_count_24h")

QUERIES = {
    "quantize_embeddings": quantize_embeddings,
    "feature_scalar_dims": partial(_features, SCALAR), "feature_time_dims": partial(_features, TIME), "feature_history_dims": partial(_features, HISTORY),
    "feature_vector_full": feature_vector_full, "mcc_risk_lookup": mcc_risk_lookup, "unknown_merchant_flag": unknown_merchant_flag,
    "reference_label_encode": reference_label_encode, "l2sq_pairs": l2sq_pairs,
    "knn_bruteforce_top5": partial(_knn, 5, "arrow"), "knn_bruteforce_sql": partial(_knn, 5, "sql"), "knn_k1": partial(_knn, 1, "arrow"), "knn_k10": partial(_knn, 10, "arrow"),
    "fraud_score_exact": fraud_score_exact, "fraud_decision_exact": fraud_decision_exact, "decision_json": decision_json_rows, "label_accuracy": label_accuracy,
    "nearest_centroids": nearest_centroids, "kmeans_assign": kmeans_assign, "kmeans_update": kmeans_update, "kmeans_2iter": kmeans_2iter, "kmeans_inertia": kmeans_inertia,
    "cluster_histogram": cluster_histogram, "cluster_padded_sizes": cluster_padded_sizes, "cluster_offsets": cluster_offsets, "cluster_ranges": cluster_ranges,
    "ivf_knn_top5": partial(_ivf, NPROBE), "ivf_full_probe_equals_exact": partial(_ivf, NLIST),
    "fraud_score_two_stage": fraud_score_two_stage, "ambiguous_queries": ambiguous_queries, "recall_at_5": recall_at_5, "nprobe_sweep": nprobe_sweep,
    "confusion_matrix": confusion_matrix, "weighted_error": weighted_error, "detection_score": detection_score, "latency_score": latency_score, "p99_value": p99_value, "final_score": final_score,
    "error_dump": error_dump, "dataset_stats": dataset_stats, "index_validate_sample": index_validate_sample, "payload_json_decode": payload_json_decode,
    "purchase_decisions": purchase_decisions, "ml_kmeans_index": ml_kmeans_index,
}

ORACLE_SQL = {
    "quantize_embeddings": f"WITH {E} SELECT vec_id, (unnest(range(1, {DIMS + 1})) - 1)::INT AS dim, unnest(q) AS q FROM v",
    "feature_scalar_dims": _select(SCALAR), "feature_time_dims": _select(TIME), "feature_history_dims": _select(HISTORY),
    "feature_vector_full": f"WITH {TX} SELECT event_id, {', '.join(f'{_q(x)} AS {n}' for n, x in FEATURE_SQL.items())} FROM tx",
    "mcc_risk_lookup": f"WITH {TX} SELECT event_id, mcc, {FEATURE_SQL['mcc_risk']} AS mcc_risk FROM tx",
    "unknown_merchant_flag": f"WITH {TX} SELECT event_id, unknown::INT AS unknown_merchant FROM tx",
    "reference_label_encode": "SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events",
    "l2sq_pairs": f"WITH {E}, {PAIRS} SELECT qid, vec_id, d FROM pairs",
    "knn_bruteforce_top5": f"WITH {E}, {PAIRS} {_top(5)}", "knn_bruteforce_sql": f"WITH {E}, {PAIRS} {_top(5)}",
    "knn_k1": f"WITH {E}, {PAIRS} {_top(1)}", "knn_k10": f"WITH {E}, {PAIRS} {_top(10)}",
    "fraud_score_exact": f"WITH {E}, {PAIRS}, {VOTES} SELECT qid, frauds, (frauds::FLOAT / 5::FLOAT)::FLOAT AS fraud_score FROM votes",
    "fraud_decision_exact": f"WITH {E}, {PAIRS}, {VOTES} SELECT qid, frauds, frauds < 3 AS approved FROM votes",
    "decision_json": f"WITH {E}, {PAIRS}, {VOTES} SELECT qid, frauds < 3 AS approved, (frauds::FLOAT / 5::FLOAT)::FLOAT AS fraud_score FROM votes",
    "label_accuracy": f"WITH {E}, {PAIRS}, {VOTES} SELECT count(*) AS n, count(*) FILTER (WHERE (frauds >= 3) = (own = 1)) AS n_right FROM votes JOIN qs USING (qid)",
    "nearest_centroids": f"WITH {KMEANS}, {PROBES} SELECT qid, cluster_id, cd, probe FROM probes WHERE probe <= 3",
    "kmeans_assign": f"WITH {E}, {SEEDS}, {_assign(0)} SELECT vec_id, cluster_id, d FROM a0",
    "kmeans_update": f"WITH {E}, {SEEDS}, {_assign(0)}, {_update(0)} SELECT cluster_id, (unnest(range(1, {DIMS + 1})) - 1)::INT AS dim, unnest(c) AS value FROM c1",
    "kmeans_2iter": f"WITH {KMEANS} SELECT cluster_id, (unnest(range(1, {DIMS + 1})) - 1)::INT AS dim, unnest(c) AS value FROM c2",
    "kmeans_inertia": f"WITH {KMEANS} SELECT sum(d)::BIGINT AS inertia, count(*) AS n_vectors FROM a2",
    "cluster_histogram": f"WITH {KMEANS}, {SIZES} SELECT * FROM sizes",
    "cluster_padded_sizes": f"WITH {KMEANS}, {SIZES} SELECT cluster_id, size, (ceil(size / 8.0) * 8)::BIGINT AS padded FROM sizes",
    "cluster_offsets": f"WITH {KMEANS}, {SIZES}, {OFFSETS} SELECT * FROM o",
    "cluster_ranges": f"WITH {KMEANS}, {SIZES}, {OFFSETS} SELECT r::INT AS cluster_id, coalesce(first_block, -1) AS first_block, coalesce(first_block + blocks, -1) AS end_block FROM range({NLIST + 2}) t(r) LEFT JOIN o ON o.cluster_id = r",
    "ivf_knn_top5": f"WITH {KMEANS}, {PROBES}, {_probed('p', NPROBE)} {_top(5, 'p')}",
    "ivf_full_probe_equals_exact": f"WITH {E}, {PAIRS} {_top(5)}",
    "fraud_score_two_stage": f"WITH {TWO} SELECT qid, frauds, second, frauds < 3 AS approved FROM two",
    "ambiguous_queries": f"WITH {TWO} SELECT qid FROM two WHERE second",
    "recall_at_5": f"WITH {KMEANS}, {PROBES}, {PAIRS}, {_probed(f'p{NPROBE}', NPROBE)} SELECT * FROM {_hits(NPROBE)}",
    "nprobe_sweep": f"WITH {KMEANS}, {PROBES}, {PAIRS}, {', '.join(_probed(f'p{n}', n) for n in (1, 2, 4, 8))} " + " UNION ALL ".join(f"SELECT {n}::INT AS nprobe, * FROM {_hits(n)}" for n in (1, 2, 4, 8)),
    "confusion_matrix": f"WITH {OUT} SELECT {COUNTS} FROM out_",
    "weighted_error": f"WITH {OUT}, c AS (SELECT {COUNTS} FROM out_) SELECT fp + 3 * fn + 5 * err AS weighted_errors, (fp + 3 * fn + 5 * err)::DOUBLE / n AS epsilon, (fp + fn + err)::DOUBLE / n AS failure_rate FROM c",
    "detection_score": f"WITH {OUT}, c AS (SELECT event_type, {COUNTS} FROM out_ GROUP BY event_type) SELECT event_type, round({_DET}, 6) AS detection_score FROM c",
    "p99_value": f"WITH {OUT} SELECT quantile_cont(latency_ms, 0.99) AS p99 FROM out_",
    "latency_score": f"WITH {OUT}, p AS (SELECT quantile_cont(latency_ms, 0.99) AS p99 FROM out_) SELECT round({_LAT}, 6) AS p99_score FROM p",
    "final_score": f"WITH {OUT}, c AS (SELECT {COUNTS}, quantile_cont(latency_ms, 0.99) AS p99 FROM out_) SELECT n, round({_DET} + {_LAT}, 6) AS final_score FROM c",
    "error_dump": f"""WITH {OUT} SELECT qid, CASE WHEN NOT ok THEN 'ERR' WHEN approved THEN 'FN' ELSE 'FP' END AS kind, approved, expected_approved
  FROM out_ WHERE NOT ok OR approved <> expected_approved""",
    "dataset_stats": """SELECT count(*) AS total, count(*) FILTER (WHERE label >= 5) AS fraud_count, count(*) FILTER (WHERE label < 5) AS legit_count,
  count(*) FILTER (WHERE label >= 5)::DOUBLE / count(*) AS fraud_rate, count(*) FILTER (WHERE label < 5)::DOUBLE / count(*) AS legit_rate FROM embeddings""",
    "index_validate_sample": "SELECT least(100, count(*)) AS n_sample, least(100, count(*)) AS n_with_neighbours, least(100, count(*)) AS n_scored, least(100, count(*)) AS n_finite FROM embeddings",
    "payload_json_decode": f"""WITH {TX} SELECT event_id, 'tx-' || event_id AS id, installments, in_day AS tx_count_24h,
  (SELECT count(DISTINCT merchant_id) FROM tx p WHERE p.user_id = tx.user_id AND (p.ts, p.event_id) < (tx.ts, tx.event_id))::INT AS n_known,
  mcc, k % 2 = 1 AS is_online, amount, strftime(last_ts, '%Y-%m-%dT%H:%M:%SZ') AS last_timestamp FROM tx""",
    "purchase_decisions": f"""WITH {TX}, f AS MATERIALIZED (SELECT event_id, event_type, {_FULL_Q} AS q FROM tx),
  fp AS (SELECT a.event_id AS qid, b.event_id AS vec_id, CASE WHEN b.event_type = 'error' THEN 1 ELSE 0 END AS label, {_d('a.q', 'b.q', 14)} AS d
    FROM f a, f b WHERE a.event_type = 'purchase' AND a.event_id % 50 = 0 AND b.event_type <> 'purchase')
  SELECT qid, sum(label)::INT AS frauds, sum(label) < 3 AS approved FROM ({_top(5, 'fp')}) GROUP BY qid""",
}
