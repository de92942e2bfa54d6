"""An index folder: vectors by cluster, centroids, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knnscore.operators.ivf import Index

VERSION = 1
META = "version int, dims int, nlist int, nprobe int, n_vectors long"


class InvalidIndex(ValueError):
    """An index folder that can't be used."""


def save(index: Index, path: str, files: int | None = None) -> None:
    """Vectors are range-partitioned and sorted by cluster: files hold neighbouring clusters, so a probe of few clusters skips the other row groups."""
    spark = index.vectors.sparkSession
    files = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = index.vectors.repartitionByRange(files, "cluster_id", "vec_id").sortWithinPartitions("cluster_id", "vec_id")
    placed.write.mode("overwrite").parquet(f"{path}/vectors")
    index.centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    n = spark.read.parquet(f"{path}/vectors").count()
    meta = spark.createDataFrame([(VERSION, index.dims, index.nlist, index.nprobe, n)], META)
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Index:
    meta = spark.read.schema(META).parquet(f"{path}/meta").collect()
    if len(meta) != 1:
        raise InvalidIndex(f"{path} has {len(meta)} rows of metadata")
    m = meta[0]
    if m.version != VERSION:
        raise InvalidIndex(f"version {m.version} of {path} isn't {VERSION}")
    vectors, centroids = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centroids")
    c = centroids.agg(F.count("*").alias("n"), F.count_distinct("cluster_id").alias("ids"), F.min(F.size("centroid")).alias("lo"), F.max(F.size("centroid")).alias("hi")).first()
    if c.n != m.nlist or c.ids != m.nlist:
        raise InvalidIndex(f"{path} has {c.n} centroids instead of {m.nlist}")
    if c.lo != m.dims or c.hi != m.dims:
        raise InvalidIndex(f"{path} has centroids of {c.lo} to {c.hi} dimensions instead of {m.dims}")
    v = vectors.agg(F.count("*").alias("n"), F.sum(F.when(F.size("q") != m.dims, 1).otherwise(0)).alias("odd")).first()
    if v.n != m.n_vectors or v.odd:
        raise InvalidIndex(f"{path} has {v.n} vectors instead of {m.n_vectors}, {v.odd} of them of other dimensions")
    return Index(vectors, centroids, m.dims, m.nlist, m.nprobe)


def is_ready(spark: SparkSession, path: str) -> bool:
    """Whether a usable index is there."""
    from pyspark.errors import AnalysisException

    try:
        load(spark, path)
    except (InvalidIndex, AnalysisException):
        return False
    return True
