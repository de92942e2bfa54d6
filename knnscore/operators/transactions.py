"""Payloads from an event log: history features by windows over a user's events, fields that the log lacks from the event's number.

A user's events are ordered by (ts, event_id). The windows partition by user; the number of merchants
bounds a row's list of known ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Category codes with a risk, and two without.
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
UNKNOWN_MCC = ("0001", "9999")
MERCHANTS = 37
DAY_US = 86_400_000_000


def from_events(events: DataFrame) -> DataFrame:
    """(event_id, event_type, id, transaction, customer, merchant, terminal, last_transaction): payload columns of every event."""
    f = lambda x: x.cast("float")
    n = F.col("event_id")
    iso = lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    user = Window.partitionBy("user_id")
    order = user.orderBy("ts", "event_id")
    day = user.orderBy("us").rangeBetween(-DAY_US, 0)
    cents = F.round(F.col("value") * 100).cast("long")
    rows = events.withColumns({
        "us": F.unix_micros(F.col("ts").cast("timestamp")),
        "merchant_id": F.concat(F.lit("MERC-"), F.lpad((n % MERCHANTS).cast("string"), 3, "0")),
        "mcc": F.element_at(F.array(*map(F.lit, [*MCC_RISK, *UNKNOWN_MCC])), (n % (len(MCC_RISK) + len(UNKNOWN_MCC)) + 1).cast("int")),
    }).withColumns({
        "last_ts": F.lag("ts").over(order), "in_day": F.count("*").over(day).cast("int"),
        "mean": f(F.floor(F.sum(cents).over(user) / F.count("*").over(user)) / 100),
        "known": F.array_sort(F.collect_set("merchant_id").over(order.rowsBetween(Window.unboundedPreceding, -1))),
    })
    last = F.struct(iso(F.col("last_ts")).alias("timestamp"), f((n % 2000) * 0.75).alias("km_from_current"))
    return rows.select(
        "event_id", "event_type", F.concat(F.lit("tx-"), n.cast("string")).alias("id"),
        F.struct(f(F.col("value") * 20).alias("amount"), (n % 12 + 1).cast("int").alias("installments"), iso(F.col("ts")).alias("requested_at")).alias("transaction"),
        F.struct(F.col("mean").alias("avg_amount"), F.col("in_day").alias("tx_count_24h"), F.col("known").alias("known_merchants")).alias("customer"),
        F.struct(F.col("merchant_id").alias("id"), "mcc", f((n % 500) * 25).alias("avg_amount")).alias("merchant"),
        F.struct((k % 2 == 1).alias("is_online"), (k % 3 == 0).alias("card_present"), f(n % 1500).alias("km_from_home")).alias("terminal"),
        F.when(F.col("last_ts").isNotNull(), last).alias("last_transaction"),
    )
