"""Shared helpers: documents, intermediate tables in the cluster's shared folder, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a local one only where none is named and driver and executors are one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("knnscore.scratch.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="knnscore-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        shared = f"file://{local}"
        spark.conf.set("knnscore.scratch.dir", shared)
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df under the shared folder and read it back: cuts lineage, survives lost executors, gives the planner true sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does just that, and faster, when all characters are ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not use (in any case), for helper columns beside unknown ones."""
    used = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out


def in_place(df: DataFrame) -> DataFrame:
    """df as a join's right side that is sorted on the executors, whatever its size: a broadcast would be built in the driver's memory."""
    return df.hint("merge")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014); each round is two grouped
    aggregations over the edges and its result is written to the shared folder. Only one number per
    round comes to the driver. Self loops and repeated edges are allowed. Neighbourhoods are never
    collected into one row, so a hub costs no memory: minima are pre-aggregated and joined back.
    """
    cur = table(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    nodes = cur.select(F.col("u").alias("node")).union(cur.select(F.col("v").alias("node"))).distinct()
    seen = None
    for _ in range(max_rounds):
        # large-star: every larger neighbour of u joins the smallest neighbour (or u itself)
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(in_place(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: u (the larger end) and its smaller neighbours join the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(in_place(low2), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        cur = table(small, "stars")
        state = cur.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(in_place(cur), nodes.node == cur.u, "left").select("node", F.coalesce("v", "node").alias("component"))


#: Quantiles of all identifiers, and again of each part between two of them.
EDGES = 256
#: Bits of a group number below those of its two quantiles.
WITHIN = 44


def range_groups(df: DataFrame, ids: DataFrame, rows: int, tie: Column, name: str = "grp") -> DataFrame:
    """df (with a column id) with a group number that doesn't decrease in the order of (id, nulls first, `tie`), for groups of about `rows` rows.

    ids holds the same identifiers. Two levels of quantiles, at most EDGES * EDGES numbers on the driver whatever the
    size, and equal steps between two of the lower level. An identifier that fills several quantiles is split by `tie`,
    a column from 0 to 2 ** 32 - 1 whose values should be even; so are nulls, whose groups are negative.
    """
    spark = df.sparkSession
    q = ", ".join(str(i / EDGES) for i in range(EDGES + 1))
    quantiles = F.expr(f"approx_percentile(id, array({q}), 10000)").alias("q")
    whole = ids.agg(F.count("*").alias("n"), F.count("id").alias("known"), quantiles).first()
    coarse = F.array(*map(F.lit, sorted(set(whole.q or [0]))))
    cell = F.greatest(F.lit(1), F.size(F.filter(coarse, lambda e: e <= F.col("id"))))
    parts = ids.where("id is not null").groupBy(cell.alias("k")).agg(F.count("*").alias("n"), quantiles).collect()
    edges = []
    for r in parts:
        share, found, since = r.n / EDGES, [], 0.0
        for v in sorted(set(r.q)):
            filled = r.q.count(v)
            splits = max(1, round((filled - 1) * share / rows))
            if not found or since >= rows or splits > 1 or found[-1][1] > 1:
                found.append((v, splits))
                since = 0.0
            since += filled * share
        edges.append((r.k, [v for v, _ in found], [t for _, t in found], max(1, round(share / rows))))
    nulls = -(-(whole.n - whole.known) // rows)
    k, e, t, steps, at = fresh(df, "_k", "_e", "_t", "_steps", "_tie")
    by = spark.createDataFrame(edges, f"{k} int, {e} array<long>, {t} array<long>, {steps} int")
    df = df.withColumn(at, tie).join(F.broadcast(by), F.when(F.col("id").isNotNull(), cell) == F.col(k), "left")
    j = F.greatest(F.lit(1), F.size(F.filter(e, lambda x: x <= F.col("id"))))
    lo, hi, split = F.element_at(e, j), F.element_at(e, F.least(j + 1, F.size(e))), F.element_at(t, j)
    part = lambda n: F.floor(F.col(at) / F.lit(float(1 << 32)) * n)
    gap = F.greatest(F.lit(1.0), hi.cast("double") - lo.cast("double"))
    step = F.greatest(F.lit(0), F.least(F.col(steps) - 1, F.floor((F.col("id").cast("double") - lo.cast("double")) / gap * F.col(steps))))
    within = F.when(F.col("id") <= lo, part(split)).otherwise(split + step)
    number = F.col(k).cast("long") * (1 << (WITHIN + 9)) + j.cast("long") * (1 << WITHIN) + within
    return df.withColumn(name, F.when(F.col("id").isNull(), part(F.lit(nulls)) - nulls).otherwise(number).cast("long")).drop(k, e, t, steps, at)


def tie_of(*columns: str) -> Column:
    """What range_groups() splits rows by that tie in identifier: a hash of these columns and of the row's place in the input."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.monotonically_increasing_id()), 32)


def group_order(groups: DataFrame, value: Column) -> DataFrame:
    """(grp, follows, before) of rows (grp, ...), one a group: the next group, after the last one the first, and the sum of `value` over groups before.

    By range_groups()' lower quantile first, so no window holds more than the groups of one, or one row for each.
    """
    upper = groups.select("grp", value.alias("_v"), F.shiftright("grp", WITHIN).alias("_up"))
    tops = upper.groupBy("_up").agg(F.min("grp").alias("_head"), F.sum("_v").alias("_sum"))
    order = Window.orderBy("_up")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(
        F.col("_up").alias("_top"), F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before"),
        F.coalesce(F.lead("_head").over(order), F.first("_head").over(order)).alias("_next"),
    )
    inner = Window.partitionBy("_up").orderBy("grp")
    here = upper.withColumn("_follows", F.lead("grp").over(inner)).withColumn("_own", F.coalesce(F.sum("_v").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return here.join(tops, F.col("_up") == F.col("_top")).select("grp", F.coalesce("_follows", "_next").alias("follows"), (F.col("_before") + F.col("_own")).alias("before"))
