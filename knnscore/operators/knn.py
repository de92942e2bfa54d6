"""Nearest neighbours: exact over all references, or over the clusters nearest to a query.

Distances are exact integers; neighbours are ordered by (distance, vec_id), so results don't depend on
partitioning. A query isn't its own neighbour where both sides have the same identifier and
`skip_self` is set.

Queries of up to QUERY_BLOCK numbers go to every task, which passes over the references where they are and
merges its best k: the references never move. More queries stay on the executors: blocks of queries meet parts of
the references as tiles of bounded size (exact search), or are joined by cluster (index search). The "sql"
strategy is a nested-loop join, an oracle for small inputs, and refuses more than MAX_PAIRS pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knnscore.functions import vectors as V
from knnscore.operators.ivf import Index
from knnscore.operators.kmeans import distances, matrix

#: Numbers of a block of queries that the driver and a task hold; numbers of a part of the references that meets one.
QUERY_BLOCK = 4_000_000
PART = 4_000_000
MAX_PAIRS = 1_000_000_000


def _best(pairs: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("qid").orderBy("d", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _schema(queries: DataFrame) -> str:
    """Of found neighbours; identifiers of queries are of any type."""
    return f"qid {queries.schema['qid'].dataType.simpleString()}, vec_id long, label int, d long"


def _none(queries: DataFrame) -> DataFrame:
    return queries.sparkSession.createDataFrame([], f"{_schema(queries)}, rank int")


def knn(queries: DataFrame, references: DataFrame, k: int = 5, dims: int = 14, strategy: str = "arrow", skip_self: bool = False) -> DataFrame:
    """(qid, vec_id, label, d, rank) of the k nearest references (vec_id, q, label) of each query (qid, q)."""
    if k <= 0:
        return _none(queries)
    if strategy == "sql":
        return _best(_pairs(queries, references, dims, skip_self), k)
    if strategy != "arrow":
        raise ValueError(f"unknown strategy {strategy}")
    return _best(_scan(queries, references, k, dims, skip_self), k)


def _pairs(queries: DataFrame, references: DataFrame, dims: int, skip_self: bool) -> DataFrame:
    spark = queries.sparkSession
    n = queries.count() * references.count()
    if n > MAX_PAIRS:
        raise ValueError(f"{n} pairs are too many for a nested loop; use the arrow strategy")
    # small inputs load as one partition, which would run the nested loop alone
    q = queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "qid").select("qid", *V.columns(F.col("q"), dims, "a"))
    r = references.select("vec_id", "label", *V.columns(F.col("q"), dims, "b"))
    d = V.squared_distance([F.col(f"a{i}") for i in range(dims)], [F.col(f"b{i}") for i in range(dims)])
    pairs = q.join(r, F.col("qid") != F.col("vec_id")) if skip_self else q.crossJoin(r)
    return pairs.select("qid", "vec_id", "label", d.alias("d"))


def _held(queries: DataFrame, dims: int, *more: str) -> pa.Table | None:
    """The queries (qid, q, more columns) if they fit a block, else None; never more than a block comes to the driver."""
    most = max(1, QUERY_BLOCK // dims)
    got = queries.select("qid", "q", *more).limit(most + 1).toArrow()
    return got if got.num_rows <= most else None


def _scan(queries: DataFrame, references: DataFrame, k: int, dims: int, skip_self: bool) -> DataFrame:
    held = _held(queries, dims)
    if held is None:
        return _tiles(queries, references, k, dims, skip_self)
    if not held.num_rows:
        return _none(queries).drop("rank")
    ids, m = held.column("qid").combine_chunks(), matrix(held.column("q").combine_chunks(), dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, m, k, skip_self)
        for b in batches:
            best.add(b.column(0), b.column(1), b.column(2))
        yield from best.batches()

    return references.select("vec_id", "q", "label").mapInArrow(run, _schema(queries))


class Best:
    """The k nearest of the references seen so far, for each of some queries."""

    def __init__(self, ids: pa.Array, m: np.ndarray, k: int, skip_self: bool):
        self.ids, self.m, self.k = ids, m, k
        self.own = ids.to_numpy(zero_copy_only=False) if skip_self else None
        #: query, distance, vec_id and label of the best, ordered by query, distance and vec_id
        self.rows = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        self.limit = np.full(len(ids), np.inf)

    def add(self, vec: pa.Array, q: pa.Array, label: pa.Array, among: np.ndarray | None = None) -> None:
        """References to compare with all queries, or with those at the places `among`."""
        asked = np.arange(len(self.ids)) if among is None else among
        dims = self.m.shape[1]
        for i in range(0, len(vec), 8192):
            v, y = (x.slice(i, 8192).to_numpy(zero_copy_only=False).astype(np.int64) for x in (vec, label))
            refs = matrix(q.slice(i, 8192), dims)
            for a in range(0, len(asked), 1024):
                at = asked[a : a + 1024]
                d = distances(self.m[at], refs)
                if self.own is not None:
                    d[self.own[at][:, None] == v[None, :]] = np.inf
                if d.shape[1] > self.k:
                    near = np.minimum(np.partition(d, self.k - 1, axis=1)[:, self.k - 1], self.limit[at])
                else:
                    near = self.limit[at]
                row, col = np.nonzero((d <= near[:, None]) & (d < np.inf))
                if len(row):
                    self._merge(at[row], d[row, col].astype(np.int64), v[col], y[col])

    def _merge(self, *new: np.ndarray) -> None:
        rows = [np.concatenate(x) for x in zip(self.rows, new, strict=True)]
        order = np.lexsort((rows[2], rows[1], rows[0]))
        rows = [x[order] for x in rows]
        first = np.searchsorted(rows[0], rows[0])
        rank = np.arange(len(first)) - first
        keep = rank < self.k
        last = rank == self.k - 1
        self.limit[rows[0][last]] = rows[1][last]
        self.rows = tuple(x[keep] for x in rows)

    def batches(self) -> Iterator[pa.RecordBatch]:
        query, d, vec, label = self.rows
        for i in range(0, len(query), 65_536):
            s = slice(i, i + 65_536)
            yield pa.RecordBatch.from_arrays(
                [self.ids.take(pa.array(query[s])), pa.array(vec[s]), pa.array(label[s].astype(np.int32)), pa.array(d[s])],
                names=["qid", "vec_id", "label", "d"],
            )


def _tiles(queries: DataFrame, references: DataFrame, k: int, dims: int, skip_self: bool) -> DataFrame:
    """Every block of queries meets every part of the references in a task of its own; both sides are of bounded size."""
    blocks = -(-queries.count() * dims // QUERY_BLOCK)
    parts = max(1, -(-references.count() * dims // PART))
    times = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block, part = F.pmod(F.xxhash64(F.lit(1), "qid"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(parts)).cast("int")
    # names of their own, since both sides may come from one table
    q = queries.select(F.col("qid").alias("qid"), F.col("q").alias("a"), block.alias("block"), times(parts).alias("part"))
    r = references.select(F.col("vec_id").alias("vec_id"), F.col("q").alias("b"), F.col("label").alias("label"), part.alias("part"), times(blocks).alias("block"))

    def tile(asked: pa.Table, refs: pa.Table) -> pa.Table:
        best = Best(asked.column("qid").combine_chunks(), matrix(asked.column("a").combine_chunks(), dims), k, skip_self)
        if refs.num_rows:
            best.add(*(refs.column(c).combine_chunks() for c in ("vec_id", "b", "label")))
        return pa.Table.from_batches(list(best.batches()), pa.schema([("qid", asked.schema.field("qid").type), ("vec_id", pa.int64()), ("label", pa.int32()), ("d", pa.int64())]))

    return q.groupBy("block", "part").cogroup(r.groupBy("block", "part")).applyInArrow(tile, _schema(queries))


def _model(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers and vectors of the centroids, a model of bounded size."""
    rows = sorted(centroids.select("cluster_id", "centroid").collect())
    return np.array([r.cluster_id for r in rows], dtype=np.int64), np.array([r.centroid for r in rows], dtype=np.float64)


def _float_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances in single precision, summed from the first dimension on."""
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for i in range(a.shape[1]):
        gap = a[:, i, None] - b[None, :, i]
        out += gap * gap
    return out


def _routes(q: np.ndarray, centroids: np.ndarray, nprobe: int, routing: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the nearest centroids of each query, nearest first, of equal ones the lowest."""
    d = distances(q, centroids) if routing == "quantized" else _float_distances(q.astype(np.float32), (centroids / V.SCALE).astype(np.float32))
    order = np.argsort(d, axis=1, kind="stable")[:, :nprobe]
    return order, np.take_along_axis(d, order, axis=1)


def nearest_clusters(queries: DataFrame, centroids: DataFrame, nprobe: int, dims: int, routing: str = "quantized") -> DataFrame:
    """(qid, cluster_id, cd, probe): the nprobe nearest centroids of each query, at most all of them, nearest first. No shuffle.

    routing="float" compares the queries' single-precision column `vector` with the centroids in single precision.
    """
    if routing not in ("quantized", "float"):
        raise ValueError(f"unknown routing {routing}")
    names, model = _model(centroids)
    kind, column = (pa.int64(), "q") if routing == "quantized" else (pa.float32(), "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                order, d = _routes(matrix(part.column(1), dims), model, nprobe, routing)
                width = order.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), width)), pa.array(names[order.ravel()], pa.int32()),
                     pa.array(d.ravel().astype(kind.to_pandas_dtype()), kind), pa.array(np.tile(np.arange(1, width + 1), part.num_rows), pa.int32())],
                    names=["qid", "cluster_id", "cd", "probe"],
                )

    return queries.select("qid", column).mapInArrow(run, f"qid {queries.schema['qid'].dataType.simpleString()}, cluster_id int, cd {'long' if kind == pa.int64() else 'float'}, probe int")


def knn_ivf(queries: DataFrame, index: Index, k: int = 5, nprobe: int | None = None, skip_self: bool = False, routing: str = "quantized") -> DataFrame:
    """(qid, vec_id, label, d, rank) among the vectors of the query's nearest clusters."""
    if k <= 0:
        return _none(queries)
    nprobe = nprobe or index.nprobe
    held = _held(queries, index.dims, *(["vector"] if routing == "float" else []))
    if held is None:
        return _ivf_join(queries, index, k, nprobe, skip_self, routing)
    if not held.num_rows:
        return _none(queries)
    ids, m = held.column("qid").combine_chunks(), matrix(held.column("q").combine_chunks(), index.dims)
    names, model = _model(index.centroids)
    order, _ = _routes(m if routing == "quantized" else matrix(held.column("vector").combine_chunks(), index.dims), model, nprobe, routing)
    by = {int(names[c]): np.flatnonzero((order == c).any(axis=1)) for c in np.unique(order)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, m, k, skip_self)
        for b in batches:
            cluster = b.column(0).to_numpy(zero_copy_only=False)
            for c in np.unique(cluster).tolist():
                if c in by:
                    rows = b.filter(pa.array(cluster == c))
                    best.add(rows.column(1), rows.column(2), rows.column(3), by[c])
        yield from best.batches()

    probed = index.vectors.where(F.col("cluster_id").isin(*by)) if len(by) < len(names) else index.vectors
    return _best(probed.select("cluster_id", "vec_id", "q", "label").mapInArrow(run, _schema(queries)), k)


def _ivf_join(queries: DataFrame, index: Index, k: int, nprobe: int, skip_self: bool, routing: str) -> DataFrame:
    """An equi-join on cluster_id; large clusters are split by adaptive execution."""
    probes = nearest_clusters(queries, index.centroids, nprobe, index.dims, routing)
    probes = probes.join(queries.select(F.col("qid").alias("_q"), F.col("q").alias("a")), F.col("qid") == F.col("_q")).select("qid", F.col("cluster_id").alias("_c"), "a")
    pairs = probes.join(index.vectors, F.col("_c") == F.col("cluster_id"))
    if skip_self:
        pairs = pairs.where("qid <> vec_id")
    d = V.squared_distance([F.col("a")[i] for i in range(index.dims)], [F.col("q")[i] for i in range(index.dims)])
    return _best(pairs.select("qid", "vec_id", "label", d.alias("d")), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_exact, n_hits, recall): exact neighbours that the search found, at whatever rank."""
    f = found.select(F.col("qid").alias("_q"), F.col("vec_id").alias("_v"), F.lit(1).alias("hit"))
    both = exact.join(f, (F.col("qid") == F.col("_q")) & (F.col("vec_id") == F.col("_v")), "left").select(F.coalesce("hit", F.lit(0)).alias("hit"))
    return both.agg(F.count("*").alias("n_exact"), F.sum("hit").cast("long").alias("n_hits")).withColumn("recall", F.col("n_hits").cast("double") / F.col("n_exact"))
