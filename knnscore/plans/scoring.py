"""From payloads to decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knnscore.functions import features as X
from knnscore.functions import vectors as V
from knnscore.operators.ivf import Index, build
from knnscore.operators.knn import knn_ivf
from knnscore.operators.vote import Probes, decide, two_stage
from knnscore.sources.index_store import InvalidIndex, load, save
from knnscore.sources.readers import with_risk


def payload_vectors(payloads: DataFrame, risks: DataFrame) -> DataFrame:
    """payloads with vector array<float> and q array<int>."""
    rows = X.add_features(with_risk(payloads, risks).withColumnRenamed("mcc_risk", "_risk"), F.col("_risk"))
    rows = rows.withColumn("vector", F.array(*X.NAMES)).select(*payloads.columns, "vector")
    return rows.withColumn("q", V.quantize_vector(F.col("vector")))


def score_payloads(payloads: DataFrame, index: Index, risks: DataFrame, probes: Probes | None = None) -> DataFrame:
    """(id, fraud_score, approved) of payloads; identifiers are expected to be distinct."""
    queries = payload_vectors(payloads, risks).select(F.col("id").alias("qid"), "q")
    return decide(two_stage(queries, index, probes or Probes.of(index))).select(F.col("qid").alias("id"), "fraud_score", "approved")


def validate(index: Index, sample: int = 100) -> DataFrame:
    """(n_sample, n_with_neighbours, n_scored, n_finite): the vectors of least hashed identifier, at most `sample`, are searched for and scored."""
    rows = index.vectors.select(F.md5(F.col("vec_id").cast("string").cast("binary")).alias("h"), F.col("vec_id").alias("qid"), "q")
    rows = rows.orderBy("h", "qid").limit(sample).drop("h")
    found = knn_ivf(rows, index).groupBy("qid").agg(F.count("*").alias("k")).select(F.col("qid").alias("_q"), "k")
    voted = decide(two_stage(rows, index, Probes.of(index))).select("qid", "fraud_score")
    both = voted.join(found, F.col("qid") == F.col("_q"), "left")
    finite = F.col("fraud_score").isNotNull() & ~F.isnan("fraud_score")
    return both.agg(F.count("*").alias("n_sample"), F.count_if(F.col("k") > 0).alias("n_with_neighbours"), F.count("fraud_score").alias("n_scored"), F.count_if(finite).alias("n_finite"))


def check(index: Index, sample: int = 100) -> None:
    """Fails where a sampled vector finds no neighbours or its score isn't a finite number."""
    r = validate(index, sample).first()
    if r.n_with_neighbours < r.n_sample or r.n_finite < r.n_sample:
        raise InvalidIndex(f"of {r.n_sample} sampled vectors {r.n_with_neighbours} have neighbours and {r.n_finite} a finite score")


def build_index(vectors: DataFrame, path: str, nlist: int, dims: int, nprobe: int = 24, iterations: int = 30) -> Index:
    """Build an index of vectors (vec_id, q, label), save it under path, load it and check it."""
    save(build(vectors, nlist, dims, nprobe, iterations), path)
    index = load(vectors.sparkSession, path)
    check(index)
    return index
