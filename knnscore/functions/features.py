"""A transaction's 14 features as FLOAT columns, step by step in single precision.

Every arithmetic result is cast to FLOAT, since Spark divides floats in double precision; rounding the
double quotient of two floats gives the single-precision quotient.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a feature is divided by, and what stands for a missing history or an unknown category.
MAX_AMOUNT, MAX_INSTALLMENTS, MAX_RATIO, MAX_MINUTES = 10000.0, 12.0, 10.0, 1440.0
MAX_KM, MAX_TX_24H, MAX_MERCHANT_AMOUNT = 1000.0, 20.0, 10000.0
NO_HISTORY, DEFAULT_RISK = -1.0, 0.5
NAMES = (
    "amount", "installments", "amount_vs_avg", "hour_of_day", "day_of_week", "minutes_since_last_tx", "km_from_last_tx",
    "km_from_home", "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_avg_amount",
)
#: Features without bounds to clamp to, and those that a first transaction lacks.
UNBOUNDED = ("hour_of_day", "day_of_week", "is_online", "card_present", "unknown_merchant", "mcc_risk")
HISTORY = ("minutes_since_last_tx", "km_from_last_tx")


def f32(x: float | Column) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def clamp01(x: Column) -> Column:
    """x in [0, 1]; NaN stays NaN (Spark orders NaN above all numbers)."""
    x = f32(x)
    return F.when(F.isnan(x), x).otherwise(F.greatest(f32(0.0), F.least(f32(1.0), x)))


def ratio(a: Column, b: float | Column) -> Column:
    """a / b in single precision; b may not be 0."""
    return f32(f32(a) / f32(b))


def digits(text: Column, start: int, stop: int) -> Column:
    """The number at fixed places of a text, null unless all are there and are digits."""
    part = F.substring(text, start + 1, stop - start)
    return F.when(part.rlike(f"^[0-9]{{{stop - start}}}$"), part.try_cast("int"))


def _part(text: Column, start: int, stop: int, default: int, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(digits(text, start, stop), F.lit(default))))


def _month_start(text: Column) -> Column:
    year = F.coalesce(digits(text, 0, 4), F.lit(1970))
    return F.make_date(year, _part(text, 5, 7, 1, 1, 12), F.lit(1))


def hour(text: Column) -> Column:
    h = digits(text, 11, 13)
    return F.when(h <= 23, h).otherwise(0)


def weekday(text: Column) -> Column:
    """Monday 0 to Sunday 6; days past a month's end roll over."""
    return F.pmod(F.weekday(_month_start(text)) + F.coalesce(digits(text, 8, 10), F.lit(1)) - 1, F.lit(7))


def epoch_days(text: Column) -> Column:
    """Days since 1970-01-01; 31 February is 2 or 3 March."""
    return F.unix_date(_month_start(text)) + _part(text, 8, 10, 1, 1, 31) - 1


def epoch_seconds(text: Column) -> Column:
    """A calendar date and time in the usual form is cast; anything else is read part by part, each with its bounds."""
    h, m, s = _part(text, 11, 13, 0, 0, 23), _part(text, 14, 16, 0, 0, 59), _part(text, 17, 19, 0, 0, 59)
    lenient = epoch_days(text).cast("long") * 86400 + h * 3600 + m * 60 + s
    usual = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"), text)
    return F.coalesce(usual.try_cast("timestamp").cast("long"), lenient)


def minutes_of(seconds: Column) -> Column:
    """Whole minutes, truncated towards zero."""
    return (seconds - seconds % 60) / 60


def minutes_between(earlier: Column, later: Column) -> Column:
    return minutes_of(epoch_seconds(later) - epoch_seconds(earlier))


def flag(x: Column) -> Column:
    return F.when(x, f32(1.0)).otherwise(f32(0.0))


def add_features(df: DataFrame, mcc_risk: Column, at: str = "") -> DataFrame:
    """df with the features of its payload struct column `at` (or of top-level payload columns) as columns NAMES.

    In steps, each a projection of its own: what several branches of a feature read is computed once, as a column.
    """
    c = lambda path: F.col(f"{at}.{path}" if at else path)
    when, last = c("transaction.requested_at"), c("last_transaction")
    amount, avg = f32(c("transaction.amount")), f32(c("customer.avg_amount"))
    least, most = f32(0.0), f32(1.0)
    seconds = epoch_seconds(when) - epoch_seconds(c("last_transaction.timestamp"))
    zero = F.when(amount > 0, most).otherwise(least)
    parts = {
        "amount": ratio(amount, MAX_AMOUNT),
        "installments": ratio(c("transaction.installments"), MAX_INSTALLMENTS),
        "amount_vs_avg": F.when(avg == 0, zero).otherwise(ratio(f32(F.try_divide(amount, avg)), MAX_RATIO)),
        "hour_of_day": ratio(hour(when), 23.0),
        "day_of_week": ratio(weekday(when), 6.0),
        "minutes_since_last_tx": ratio(minutes_of(F.col("_seconds")), MAX_MINUTES),
        "km_from_last_tx": ratio(c("last_transaction.km_from_current"), MAX_KM),
        "km_from_home": ratio(c("terminal.km_from_home"), MAX_KM),
        "tx_count_24h": ratio(c("customer.tx_count_24h"), MAX_TX_24H),
        "is_online": flag(c("terminal.is_online")),
        "card_present": flag(c("terminal.card_present")),
        "unknown_merchant": flag(~F.array_contains(c("customer.known_merchants"), c("merchant.id"))),
        "mcc_risk": f32(F.coalesce(mcc_risk, f32(DEFAULT_RISK))),
        "merchant_avg_amount": ratio(c("merchant.avg_amount"), MAX_MERCHANT_AMOUNT),
    }
    out = df.withColumns({"_seconds": seconds, "_first": last.isNull()}).withColumns({f"_{n}": f32(parts[n]) for n in NAMES})

    def bounded(name: str) -> Column:
        x = F.col(f"_{name}")
        if name in UNBOUNDED:
            return x
        return F.when(F.col("_first"), f32(NO_HISTORY)).otherwise(clamp01(x)) if name in HISTORY else clamp01(x)

    out = out.withColumns({n: f32(bounded(n)) for n in NAMES})
    return out.drop("_seconds", "_first", *(f"_{n}" for n in NAMES))
