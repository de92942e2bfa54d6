"""k-means over quantized vectors: seeding, assignment, update, and two ways to iterate.

`iterate_sql` is plain relational algebra in integers, the same in any engine and for any partitioning.
`fit` is the production path: each iteration is one pass over the vectors in Arrow batches that returns
per-cluster sums, so vectors never move; only the centroids, a model of fixed size, are on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knnscore.functions import vectors as V

#: Most numbers of a centroid table that the driver and each task hold.
MAX_MODEL = 16_000_000


def seeds(vectors: DataFrame, nlist: int) -> DataFrame:
    """(cluster_id, centroid): the nlist vectors whose identifiers have the least MD5, numbered in that order."""
    if nlist < 1:
        raise ValueError("nlist must be 1 or more")
    first = vectors.select(F.md5(F.col("vec_id").cast("string").cast("binary")).alias("h"), "q").orderBy("h").limit(nlist)
    numbered = first.agg(F.array_sort(F.collect_list(F.struct("h", "q"))).alias("s"))
    return numbered.select(F.posexplode("s").alias("cluster_id", "c")).select("cluster_id", F.col("c.q").alias("centroid"))


def assign_sql(vectors: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """vectors with cluster_id and d (squared distance): the nearest centroid, of equal ones the lowest."""
    c = centroids.select(F.col("cluster_id"), *V.columns(F.col("centroid"), dims, "c"))
    flat = vectors.select("*", *V.columns(F.col("q"), dims, "q"))
    d = V.squared_distance([F.col(f"q{i}") for i in range(dims)], [F.col(f"c{i}") for i in range(dims)])
    pairs = flat.crossJoin(F.broadcast(c)).select(*vectors.columns, d.alias("d"), "cluster_id")
    best = pairs.groupBy("vec_id").agg(F.min(F.struct("d", "cluster_id")).alias("b"), *(F.any_value(x).alias(x) for x in vectors.columns if x != "vec_id"))
    return best.select(*vectors.columns, "b.cluster_id", "b.d")


def update_sql(assigned: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """New centroids: rounded means; a cluster without vectors keeps its centroid."""
    sums = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"), *(F.sum(F.col("q")[i].cast("long")).alias(f"s{i}") for i in range(dims)))
    mean = F.array(*(F.round(F.col(f"s{i}").cast("double") / F.col("n")).cast("int") for i in range(dims)))
    new = sums.select(F.col("cluster_id").alias("_c"), mean.alias("_mean"))
    return centroids.join(new, F.col("cluster_id") == F.col("_c"), "left").select("cluster_id", F.coalesce("_mean", "centroid").alias("centroid"))


def iterate_sql(vectors: DataFrame, centroids: DataFrame, dims: int, iterations: int) -> DataFrame:
    """Centroids after a fixed number of rounds of assignment and update."""
    for _ in range(iterations):
        centroids = update_sql(assign_sql(vectors, centroids, dims), centroids, dims)
    return centroids


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("d").alias("inertia"), F.count("*").alias("n_vectors"))


def matrix(column: pa.ListArray | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A list column without nulls as a float64 matrix: integers of 16 bits stay exact in products."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dims)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows, exact below 2 ** 53."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assign_sql in Arrow batches: no shuffle."""
    dims = centroids.shape[1]
    at = vectors.columns.index("q")
    schema = vectors.select("*", F.lit(0).alias("cluster_id"), F.lit(0).cast("long").alias("d")).schema
    types = {"cluster_id": pa.int32(), "d": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                d = distances(matrix(part.column(at), dims), centroids)
                c = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c, types["cluster_id"]), pa.array(d[np.arange(len(c)), c].astype(np.int64), types["d"])], names=[*b.schema.names, "cluster_id", "d"])

    return vectors.mapInArrow(run, schema)


def fit(vectors: DataFrame, nlist: int, dims: int, iterations: int = 30) -> tuple[np.ndarray, list[int]]:
    """(centroids, inertia before each round) by fixed rounds of Lloyd's algorithm."""
    if nlist * dims > MAX_MODEL:
        raise ValueError(f"{nlist} centroids of {dims} dimensions are more than {MAX_MODEL} numbers")
    start = seeds(vectors, nlist).orderBy("cluster_id").collect()
    if len(start) < nlist:
        raise ValueError(f"{len(start)} vectors can't make {nlist} clusters")
    centroids, trace = np.array([r.centroid for r in start], dtype=np.float64), []
    for _ in range(iterations):
        held = centroids

        def run(batches: Iterator[pa.RecordBatch], held: np.ndarray = held) -> Iterator[pa.RecordBatch]:
            sums, n, cost = np.zeros_like(held), np.zeros(len(held), dtype=np.int64), 0
            for b in batches:
                for i in range(0, b.num_rows, 4096):
                    m = matrix(b.slice(i, 4096).column(0), dims)
                    d = distances(m, held)
                    c = d.argmin(axis=1)
                    np.add.at(sums, c, m)
                    n += np.bincount(c, minlength=len(held))
                    cost += int(d[np.arange(len(c)), c].sum())
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(n[used]), pa.array([x.astype(np.int64) for x in sums[used]], pa.list_(pa.int64())), pa.array([cost if k == 0 else 0 for k in range(len(used))], pa.int64())],
                names=["cluster_id", "n", "sums", "cost"],
            )

        parts = vectors.select("q").mapInArrow(run, "cluster_id int, n long, sums array<long>, cost long")
        total = parts.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims))).collect()
        new = centroids.copy()
        for r in total:
            mean = np.array([r[f"s{i}"] for i in range(dims)], dtype=np.float64) / r.n
            new[r.cluster_id] = np.sign(mean) * np.floor(np.abs(mean) + 0.5)
        trace.append(sum(r.cost for r in total))
        centroids = new
    return centroids, trace


def table_of(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [int(x) for x in row]) for i, row in enumerate(centroids)], "cluster_id int, centroid array<int>")


def fit_ml(vectors: DataFrame, nlist: int, iterations: int = 30, seed: int = 42) -> tuple[DataFrame, float]:
    """(vectors with cluster_id, training cost) by pyspark.ml's k-means with its parallel k-means++ start."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("_v", array_to_vector(F.col("q").cast("array<double>")))
    model = KMeans(k=nlist, maxIter=iterations, tol=0.0, seed=seed, featuresCol="_v", predictionCol="cluster_id").fit(rows)
    return model.transform(rows).drop("_v"), float(model.summary.trainingCost)

