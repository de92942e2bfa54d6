"""Document fingerprints: canonical exact digests (native).

A text is put in Unicode normal form KC, its case folded in full (so that ß is ss and every sigma the same), put in
form KC again, its white space folded to single spaces, and digested to 128 bits by two xxHash64 passes of
different seeds. Documents are grouped by that digest and compared byte by byte inside a group: if a group
ever holds different canonical texts, each gets a suffix of its own, so equal fingerprints mean equal
canonical texts. The comparison is a grouping by (digest, canonical text), which each task pre-aggregates,
of digests that occur more than once. Edited texts, which are only made in passing, take part by their SHA-256.

Likeness of two exact fingerprints is 1 when they are equal and 0 otherwise.

Null text counts as empty. A null identifier sorts before all others; rows that tie in identifier
are ordered by text (if they fill several window groups, first by a hash of text and place in the input). Repeated rows are documents of their own. Empty input gives an empty result; a
single document is its own next one. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, group_order, range_groups, table, tie_of

SEEDS = (42, 7)
#: Documents that one window group should hold, about.
GROUP_ROWS = 1024


def _icu(class_: str, method: str, text: Column) -> Column:
    """A static method of the ICU library that Spark carries, with its flag set; reflect() can't take nulls."""
    return F.reflect(F.lit(f"com.ibm.icu.{class_}"), F.lit(method), F.coalesce(text, F.lit("")), F.lit(True))


def canonical(text: Column) -> Column:
    """Normal form KC of the folded normal form KC, single spaces; for ASCII texts lower() does the same."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = text
    for class_, method in (("text.Normalizer", "compose"), ("lang.UCharacter", "foldCase"), ("text.Normalizer", "compose")):
        folded = _icu(class_, method, folded)
    normal = F.when(text.isNotNull(), F.when(ascii_only, F.lower(text)).otherwise(folded))
    return F.trim(F.regexp_replace(normal, r"[\s\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """struct of two longs; xxhash64 chains over its arguments, so a leading literal is a seed."""
    return F.struct(*(F.xxhash64(F.lit(s), canon).alias(f"h{i}") for i, s in enumerate(SEEDS)))


def show(dig: Column, variant: Column) -> Column:
    plain = F.lower(F.concat(*(F.lpad(F.hex(dig[f"h{i}"]), 16, "0") for i in range(len(SEEDS)))))
    return F.when(variant > 0, F.concat_ws("-", plain, variant.cast("string"))).otherwise(plain)


def by_bytes(texts: DataFrame) -> DataFrame:
    """(digest, sha), one row for each text of a digest that several rows of texts (digest, canon) have; grouped by the texts themselves."""
    # a table, so that the planner knows its size and needn't move the texts where it is small
    repeated = table(texts.groupBy("digest").count().where("count > 1").select(F.col("digest").alias("d")), "repeated")
    found = texts.join(repeated, F.col("digest") == F.col("d"), "left_semi").groupBy("digest", "canon").agg(F.count("*").alias("n"))
    return found.select("digest", F.sha2("canon", 256).alias("sha"))


def variants(found: DataFrame) -> DataFrame:
    """(digest, sha, variant) of digests that different texts share, from rows (digest, sha); empty unless hashes collide."""
    found = table(found.distinct(), "digests")
    split = found.groupBy("digest").count().where("count > 1").select(F.col("digest").alias("d"))
    shas = found.join(split, F.col("digest") == F.col("d"), "left_semi")
    return shas.withColumn("variant", F.row_number().over(Window.partitionBy("digest").orderBy("sha")) - 1)


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; equal fingerprints mean equal canonical texts."""
    canon = canonical(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(id_col).alias("id"), canon.alias("canon")).withColumn("digest", digest(F.col("canon")))
    other = table(variants(by_bytes(texts)), "variants").select(F.col("digest").alias("d"), F.col("sha").alias("s"), "variant")
    joined = texts.join(other, (F.col("digest") == F.col("d")) & (F.sha2("canon", 256) == F.col("s")), "left")
    return joined.select("id", show(F.col("digest"), F.coalesce("variant", F.lit(0))).alias("fingerprint"))


def edit(text: Column, n: Column, following: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many of the following text."""
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n.cast("int") - half), F.substring(following, F.lit(1), half))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The texts move once: by window group, a range of identifiers. A group's last document looks for its
    next one in the following group, among the first documents of groups (one row per GROUP_ROWS).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    own = rows.withColumn("canon", canonical(F.col("text")))
    own = own.select("id", "text", F.char_length("text").cast("long").alias("n"), digest(F.col("canon")).alias("digest"), F.sha2("canon", 256).alias("sha"))
    own = range_groups(own, docs.select(F.col(id_col).alias("id")), GROUP_ROWS, tie_of("text"))
    by = Window.partitionBy("grp").orderBy(F.asc_nulls_first("id"), "text")
    near = own.withColumns({
        "next_text": F.lead("text").over(by), "next_digest": F.lead("digest").over(by), "first": F.row_number().over(by) == 1,
    })
    keep = ["id", "grp", "n", "digest", "sha", "text", "next_text", "next_digest", "first"]
    edge = F.col("first") | F.col("next_text").isNull()
    done = _compared(near.select(*keep)).withColumn("edge_text", F.when(edge, F.col("text")))
    done = table(done.drop("text", "next_text"), "compared")
    # one row per window group from here on
    heads = done.where("first").select("grp", F.col("edge_text").alias("next_text"), F.col("digest").alias("next_digest"))
    order = group_order(done.select("grp").distinct(), F.lit(1)).select("grp", "follows")
    ends = done.where("edited_sha256 is null").select("id", "grp", "n", "digest", "sha", F.col("edge_text").alias("text"), "first")
    heads = heads.withColumnRenamed("grp", "follows")
    ends = _compared(ends.join(order, "grp").join(heads, "follows"))
    names = ["id", "n", "digest", "sha", "edited_sha256", "edited_digest", "edited_canon_sha", "near_edited", "near_next"]
    every = done.where("edited_sha256 is not null").select(*names).unionByName(ends.select(*names))
    canon = canonical(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(canon.alias("canon")).withColumn("digest", digest(F.col("canon")))
    edited = every.select(F.col("edited_digest").alias("digest"), F.col("edited_canon_sha").alias("sha"))
    other = table(variants(by_bytes(texts).union(every.select("digest", "sha")).union(edited)), "variants")
    for c, s, out in (("digest", "sha", "fingerprint"), ("edited_digest", "edited_canon_sha", "edited_fingerprint")):
        v = other.select(F.col("digest").alias("d"), F.col("sha").alias("s"), "variant")
        every = every.join(v, (F.col(c) == F.col("d")) & (F.col(s) == F.col("s")), "left")
        every = every.withColumn(out, show(F.col(c), F.coalesce("variant", F.lit(0)))).drop("d", "s", "variant")
    return every.select("id", F.col("n").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _compared(rows: DataFrame) -> DataFrame:
    """Adds the edited text's digests and the two likenesses; nulls where next_text is null. Equal digests are compared by their bytes."""
    out = rows.withColumn("edited", edit(F.col("text"), F.col("n"), F.col("next_text")))
    out = out.withColumn("edited_canon", canonical(F.col("edited")))
    out = out.withColumn("edited_digest", F.when(F.col("edited_canon").isNotNull(), digest(F.col("edited_canon"))))
    same = lambda d, t: F.when(F.col("digest") == F.col(d), canonical(F.col("text")) == t).otherwise(False)
    return out.withColumns({
        "edited_sha256": F.sha2("edited", 256), "edited_canon_sha": F.sha2("edited_canon", 256),
        "near_edited": same("edited_digest", F.col("edited_canon")).cast("double"),
        "near_next": same("next_digest", canonical(F.col("next_text"))).cast("double"),
    }).drop("edited", "edited_canon", "next_digest")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
