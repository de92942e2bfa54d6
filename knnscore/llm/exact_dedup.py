"""Exact dedup by a tree merge of sorted digest runs (native).

Every slot, at first an input partition, has a run of digests. In each binomial round slots exchange: the
next few bits of a row's slot are replaced by bits of its digest, so 2 ** FAN_IN_BITS runs meet in one slot. Rows
move by slot alone; a slot is one sorted run in one task, where equal digests lie together and are merged to one
row with the winning identifier and the count. After the last round a slot holds all rows of its digests and
nothing else. A digest that a third of all rows share is spread over all slots of the first round with its first
bits, and is one row in each from then on, so no task ever gets its rows. The 64-bit sort key is verified at
every level by the full SHA-256 of the text, which is part of what is sorted and merged by; texts of equal SHA-256
count as equal and aren't compared again.

Null text counts as empty. A null identifier loses to any other. Rows that agree in identifier and
text are told apart by their place in the input: exactly one of a group is kept. Empty input gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, fresh, table

FAN_IN_BITS = 3


def _digests(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    sha = F.unhex(F.sha2(text, 256))
    return docs.select(F.col(id_col).alias("id"), sha.alias("sha")).select(
        "id", "sha", F.xxhash64("sha").alias("key"), F.monotonically_increasing_id().alias("uid")
    )


def merge_runs(digests: DataFrame, keep: str = "max", fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """(key, sha, best struct(id, uid), n) for each distinct digest of rows (id, uid, key, sha)."""
    spark = digests.sparkSession
    bits = max(1, math.ceil(math.log2(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    rounds = math.ceil(bits / fan_in_bits)
    pick = F.max if keep == "max" else F.min
    best = F.struct("id", "uid")
    # uid holds the partition in its upper 31 bits and its rows' numbers in the others; few partitions are dealt to all slots
    start = F.xxhash64(F.shiftrightunsigned("uid", 33), F.shiftrightunsigned("uid", 10)).bitwiseAND(F.lit((1 << bits) - 1))
    runs = digests.select(start.alias("slot"), "key", "sha", best.alias("best"), F.lit(1).cast("long").alias("n"))
    for k in range(rounds):
        low = k * fan_in_bits
        mask = ((1 << min(fan_in_bits, bits - low)) - 1) << low
        slot = F.col("slot").bitwiseAND(F.lit(~mask)).bitwiseOR(F.col("key").bitwiseAND(F.lit(mask)))
        moved = runs.select(slot.alias("slot"), "key", "sha", "best", "n").repartition(1 << bits, "slot")
        # the grouping needs no exchange of its own: it merges what the slot's sorted run brings together
        runs = moved.sortWithinPartitions("slot", "key", "sha").groupBy("slot", "key", "sha").agg(pick("best").alias("best"), F.sum("n").alias("n"))
    return runs.select("key", "sha", "best", "n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """(id, keep_id, group_size, kept, sha) for every row; texts are equal when identical after A-Z is lower-cased."""
    rows = table(_digests(docs, id_col, ascii_lower(F.coalesce(F.col(text_col), F.lit("")))), "digests")
    best = merge_runs(rows, keep).withColumnsRenamed({"key": "k2", "sha": "s2"})
    return rows.join(best, (F.col("key") == F.col("k2")) & (F.col("sha") == F.col("s2"))).select(
        "id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("uid") == F.col("best.uid")).alias("kept"), F.lower(F.hex("sha")).alias("sha"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the one with the largest (or smallest) identifier.

    docs isn't copied: its rows are found again by identifier and digest. Of rows that agree in both any one stays.
    """
    sha, best, same = fresh(docs, "sha", "best", "same")
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = table(_digests(docs, id_col, text), "digests")
    repeats = rows.groupBy("id", "sha").count().where("count > 1").select(F.col("id").alias("i"), F.col("sha").alias("s"))
    stay = merge_runs(rows, keep).select(F.col("best.id").alias(best), F.col("sha").alias(same))
    stay = table(stay.join(repeats, (F.col(same) == F.col("s")) & F.col(best).eqNullSafe(F.col("i")), "left").select(best, same, F.col("s").isNotNull().alias("many")), "stay")
    marked = docs.withColumn(sha, F.unhex(F.sha2(text, 256)))
    kept = lambda by: marked.join(by, (F.col(sha) == F.col(same)) & F.col(id_col).eqNullSafe(F.col(best)), "left_semi")
    out = kept(stay.where("not many"))
    many = stay.where("many")
    if not many.isEmpty():  # rows that repeat identifier and text: only these move a second time
        out = out.unionByName(kept(many).dropDuplicates([id_col, sha]))
    return out.select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
