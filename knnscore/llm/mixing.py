"""Mixing sources to target weights by capped water-filling (native).

Each source gets a target in proportion to its weight; one that would need more than `max_epochs`
passes is clamped there and the excess goes to the others in proportion, until none is above. Sources
are clamped in ascending order of capacity per weight, so the level comes from running sums over one
row per source. Every document is then taken floor(target / size) whole times, and a seeded order
of the source's documents, cut at the words that are still missing, takes one more time: the document
at the cut is taken in part, so a source's words meet its target to within one word.

The order is by a hash of seed and identifier. Its running sum is two-level: sums of hash ranges of
a source, then a window within one range, so a source with a third of all rows is many small groups.

Null text has size 0 and is taken 0 times. A null source is a source of its own, the last. Rows that
repeat an identifier are documents of their own; if they also tie in size, which of them takes the
extra words is not defined, but the rows returned are. A source without words has target 0. Empty input
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, fresh, table

RANGE_ROWS = 20_000


def targets(sizes: DataFrame, weights: Sequence[int], total: float, max_epochs: int) -> DataFrame:
    """(source, source_size, target, n_rows) by water-filling over rows (source, size). One row per source meets in a window."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    by_name, by_ratio = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("ratio", "pos")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("pos") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("pos", F.row_number().over(by_name)).withColumn("w", weight.cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    per = per.withColumns({
        "clamped_before": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)),
        "weight_left": F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        "goal": F.sum("source_size").over(everything).cast("double") * total,
    })
    per = per.withColumn("clamped", F.col("cap") * F.col("weight_left") < F.col("w") * (F.col("goal") - F.col("clamped_before")))
    left = F.col("goal") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("clamped"), 0.0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("w") * left / free)
    return per.select("source", "source_size", target.alias("target"), "n_rows")


def mix(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), total: float = 1.5, max_epochs: int = 2, seed: str = "mix-1") -> DataFrame:
    """sizes has (id, source, size) and is read several times: give a table. Adds source_size, target, taken and keeps all columns."""
    goal = targets(sizes.select("source", "size"), weights, total, max_epochs)
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    n = sizes.count()
    # a power of two, up to 2^24 ranges of the order's first six hex digits
    shift = max(0, 24 - (n // RANGE_ROWS).bit_length())
    ranged = sizes.withColumn("_order", order).withColumn(
        "_range", F.shiftright(F.conv(F.substring("_order", 1, 6), 16, 10).cast("int"), shift)
    )
    sums = ranged.groupBy("source", "_range").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("_range")) - F.col("words")
    goal = goal.withColumnRenamed("source", "source_")
    sums = sums.select("source", "_range", before.alias("before")).join(goal, F.col("source").eqNullSafe(F.col("source_"))).select(
        F.col("source").alias("source_"), F.col("_range").alias("range_"), "before", "source_size", "target"
    )
    local = Window.partitionBy("source", "_range").orderBy("_order", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("size").over(local))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("source_")) & (F.col("_range") == F.col("range_")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    quota = F.floor(F.col("target") + 0.5).cast("long") - whole * F.col("source_size")
    start = F.col("before") + F.col("upto") - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), quota - start))
    return placed.withColumn("taken", (whole * F.col("size") + part).cast("long")).select(*sizes.columns, "source_size", "target", "taken")


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as documents: each row as often as its taken words are whole passes over it; a part counts as a pass from one half on.

    A document without words is kept once. Columns are those of docs. Documents are found again by identifier, source and the
    SHA-256 of their text, so docs isn't copied; rows that agree in these are repeated alike.
    """
    uid, repeats, key, at = fresh(docs, "uid", "repeats", "key", "at")
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = table(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _digest(F.col(text_col)).alias("row"), words.alias("size")), "sizes")
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    taken = mix(sizes, **how).groupBy("id", "source", "row").agg(F.max(times).alias(repeats)).where(F.col(repeats) > 0)
    taken = taken.select(F.col("id").alias(at), F.col("source").alias(key), F.col("row"), repeats).withColumnRenamed("row", f"{key}_row")
    same = (F.col(uid) == F.col(f"{key}_row")) & F.col(id_col).eqNullSafe(F.col(at)) & F.col(source_col).eqNullSafe(F.col(key))
    joined = docs.withColumn(uid, _digest(F.col(text_col))).join(taken, same)
    copy = F.explode(F.sequence(F.lit(1), F.col(repeats)))
    return joined.select(*docs.columns, copy.alias(uid)).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(document_sizes(documents(spark, sf_dir)), "sizes")
    return mix(sizes).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         sha256('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS ord
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos
  FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][((pos - 1) % 3 + 1)::INT]::DOUBLE AS w, (source_size * 2)::DOUBLE AS cap,
         sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS goal FROM per),
summed AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
         sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_ FROM weighed),
clamp AS (SELECT *, cap * left_ < w * (goal - before_) AS clamped FROM summed),
goals AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN cap ELSE w * (goal - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ())
              / sum(CASE WHEN clamped THEN 0 ELSE w END) OVER () END AS target FROM clamp),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END::BIGINT AS whole,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target + 0.5)::BIGINT - whole * source_size - start)))::BIGINT AS taken
FROM placed
"""
