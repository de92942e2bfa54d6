"""The inverted-file index: vectors by cluster, and figures about it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knnscore.functions import vectors as V
from knnscore.operators import kmeans

BLOCK = 8


@dataclass(frozen=True)
class Index:
    """vectors (cluster_id, vec_id, q, label) and centroids (cluster_id, centroid), quantized both."""

    vectors: DataFrame
    centroids: DataFrame
    dims: int
    nlist: int
    nprobe: int = 24


def quantized(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    return vectors.withColumn("q", V.quantize_vector(F.col(vector))).drop(vector)


def build(vectors: DataFrame, nlist: int, dims: int, nprobe: int = 24, iterations: int = 30) -> Index:
    """vectors: (vec_id, q, label). Every vector is assigned to its centroid after the last update."""
    centroids, _ = kmeans.fit(vectors, nlist, dims, iterations)
    placed = kmeans.assign(vectors.select("vec_id", "q", "label"), centroids).drop("d")
    return Index(placed, kmeans.table_of(vectors.sparkSession, centroids), dims, nlist, nprobe)


def histogram(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("size"))


def padded(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sizes if clusters were stored in whole blocks."""
    return sizes.withColumn("padded", V.align_up(F.col("size"), block))


def offsets(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """First block of each cluster: a running sum over one row per cluster."""
    blocks = (V.align_up(F.col("size"), block) / block).cast("long")
    before = F.sum("blocks").over(Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("blocks", blocks).withColumn("first_block", F.coalesce(before, F.lit(0)))


def cluster_range(offset_table: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cluster_id, first_block, end_block) of wanted clusters, null where there is no such cluster."""
    o = offset_table.select(F.col("cluster_id").alias("_c"), "first_block", (F.col("first_block") + F.col("blocks")).alias("end_block"))
    return wanted.join(o, F.col("cluster_id") == F.col("_c"), "left").select("cluster_id", "first_block", "end_block")
