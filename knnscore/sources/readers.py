"""Sources and sinks of scoring: references, transactions, category risks, evaluation sets, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knnscore.schema import DIMS, EVALUATION, PAYLOAD, REFERENCE, REQUIRED


class EmptySource(ValueError):
    """A source without a row."""


def is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether the first character that isn't white space is "["; gzip is seen through. An empty file is an error."""
    first = spark.read.text(path).where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").limit(1).collect()
    if not first:
        raise EmptySource(f"{path} is empty")
    return first[0].value.lstrip().startswith("[")


def read_json(spark: SparkSession, path: str, schema, array: bool | None = None) -> DataFrame:
    """JSON array or one object a line, told apart by the first character; malformed input fails."""
    array = is_json_array(spark, path) if array is None else array
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", array).json(path)


def encode_label(label: Column) -> Column:
    """"fraud" is 1, anything else 0."""
    return F.when(label == "fraud", 1).otherwise(0)


def read_references(spark: SparkSession, path: str, dims: int = DIMS, partitions: int | None = None) -> DataFrame:
    """(vec_id, vector, label) of a reference file; vectors of another length fail. Compressed files aren't split, so rows are dealt out."""
    raw = read_json(spark, path, REFERENCE)
    if raw.isEmpty():
        raise EmptySource(f"{path} has no references")
    checked = F.when(F.assert_true(F.coalesce(F.size("vector") == dims, F.lit(False)), F.lit(f"a vector doesn't have {dims} numbers")).isNull(), F.col("vector"))
    rows = raw.select(F.monotonically_increasing_id().alias("vec_id"), checked.alias("vector"), encode_label(F.col("label")).alias("label"))
    return rows.repartition(partitions) if partitions else rows


def valid(at: str = "") -> Column:
    """Whether all required fields are there and counts aren't negative."""
    c = lambda p: F.col(f"{at}.{p}" if at else p)
    ok = F.lit(True)
    for p in REQUIRED:
        ok = ok & c(p).isNotNull()
    last = c("last_transaction").isNull() | (c("last_transaction.timestamp").isNotNull() & c("last_transaction.km_from_current").isNotNull())
    return ok & last & F.coalesce((c("transaction.installments") >= 0) & (c("customer.tx_count_24h") >= 0), F.lit(False))


def parse_payloads(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(payloads, refused): JSON texts as payload columns; malformed or incomplete ones are refused with their text. Works on streams."""
    parsed = lines.select(F.col(column).alias("text"), F.from_json(F.col(column).cast("string"), PAYLOAD, {"mode": "PERMISSIVE"}).alias("p"))
    good = F.coalesce(valid("p"), F.lit(False))
    return parsed.where(good).select("p.*"), parsed.where(~good).select("text")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, PAYLOAD)


def read_risks(spark: SparkSession, path: str) -> DataFrame:
    """(mcc, risk) of a JSON object of risks by category code."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,float>")).alias("mcc", "risk"))


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """(request, expected_approved, expected_fraud_score) of an evaluation file."""
    return read_json(spark, path, EVALUATION, array=True).select(F.explode("entries").alias("e")).select("e.*")


def with_risk(payloads: DataFrame, risks: DataFrame, mcc: str = "merchant.mcc") -> DataFrame:
    """Adds mcc_risk, null for unknown categories. The planner broadcasts the table of categories by its size."""
    r = risks.select(F.col("mcc").alias("_mcc"), F.col("risk").alias("mcc_risk"))
    return payloads.join(r, F.col(mcc) == F.col("_mcc"), "left").drop("_mcc")


def decision_json(approved: Column, score: Column) -> Column:
    return F.to_json(F.struct(approved.alias("approved"), score.alias("fraud_score")))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
