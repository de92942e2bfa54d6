"""Features, dates and quantization: golden values and edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from knnscore.functions import features as X
from knnscore.functions import vectors as V
from knnscore.operators.transactions import MCC_RISK
from knnscore.plans.scoring import payload_vectors
from knnscore.schema import PAYLOAD
from knnscore.sources.readers import parse_payloads

#: Three payloads and their quantized feature vectors.
GOLDEN = [
    ({"id": "tx-1329056812", "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"}, "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]}, "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25}, "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.2331036248}, "last_transaction": None},
     [41, 1667, 500, 7826, 3333, -10000, -10000, 292, 1500, 0, 10000, 0, 1500, 60]),
    ({'id': 'tx-3576980410', 'transaction': {'amount': 384.88, 'installments': 3, 'requested_at': '2026-03-11T20:23:35Z'}, 'customer': {'avg_amount': 769.76, 'tx_count_24h': 3, 'known_merchants': ['MERC-009', 'MERC-009', 'MERC-001', 'MERC-001']}, 'merchant': {'id': 'MERC-001', 'mcc': '5912', 'avg_amount': 298.95}, 'terminal': {'is_online': False, 'card_present': True, 'km_from_home': 13.7090520965}, 'last_transaction': {'timestamp': '2026-03-11T14:58:35Z', 'km_from_current': 18.8626479774}}, [385, 2500, 500, 8696, 3333, 2257, 189, 137, 1500, 0, 10000, 0, 2000, 299]),
    ({'id': 'tx-3330991687', 'transaction': {'amount': 9505.97, 'installments': 10, 'requested_at': '2026-03-14T05:15:12Z'}, 'customer': {'avg_amount': 81.28, 'tx_count_24h': 20, 'known_merchants': ['MERC-008', 'MERC-007', 'MERC-005']}, 'merchant': {'id': 'MERC-068', 'mcc': '7802', 'avg_amount': 54.86}, 'terminal': {'is_online': False, 'card_present': True, 'km_from_home': 952.2745933273}, 'last_transaction': None}, [9506, 8333, 10000, 2174, 8333, -10000, -10000, 9523, 10000, 0, 10000, 10000, 7500, 55]),
]


def risks(spark):
    return spark.createDataFrame(list(MCC_RISK.items()), "mcc string, risk float")


def payload(**changes):
    p = json.loads(json.dumps(GOLDEN[0][0]))
    for path, v in changes.items():
        *parents, last = path.split("__")
        at = p
        for k in parents:
            at = at[k]
        at[last] = v
    return p


def vector(spark, p):
    df = spark.createDataFrame([(json.dumps(p),)], "value string").select(F.from_json("value", PAYLOAD).alias("p")).select("p.*")
    return payload_vectors(df, risks(spark)).first()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("p,expected", GOLDEN, ids=[p["id"] for p, _ in GOLDEN])
def test_golden_vectors(spark, p, expected):
    assert vector(spark, p).q == expected


def test_edges(spark):
    at = lambda **c: dict(zip(X.NAMES, vector(spark, payload(**c)).vector, strict=True))
    assert at(customer__avg_amount=0.0)["amount_vs_avg"] == 1.0
    assert at(customer__avg_amount=0.0, transaction__amount=0.0)["amount_vs_avg"] == 0.0
    assert at(transaction__amount=-5.0)["amount"] == 0.0
    assert at(transaction__amount=1e9)["amount"] == 1.0
    assert at(merchant__mcc="9999")["mcc_risk"] == 0.5
    assert at(customer__known_merchants=[])["unknown_merchant"] == 1.0
    assert at(customer__known_merchants=["MERC-016", "MERC-016"])["unknown_merchant"] == 0.0
    later = {"timestamp": "2026-03-12T00:00:00Z", "km_from_current": 5000.0}
    assert at(last_transaction=later)["minutes_since_last_tx"] == 0.0
    assert at(last_transaction=later)["km_from_last_tx"] == 1.0


@pytest.mark.parametrize("iso,hour", [("2026-03-11T18:45:53Z", 18), ("2026-03-11T00:00:00Z", 0), ("2026-03-11T05:15:12Z", 5), ("2026-03-11T23:59:59Z", 23), ("2026-03-11T24:00:00Z", 0), ("junk", 0), ("", 0)])
def test_hour(spark, iso, hour):
    assert value(spark, X.hour(F.lit(iso))) == hour


@pytest.mark.parametrize("iso,day", [("2026-03-11", 2), ("2026-03-14", 5), ("2026-03-15", 6), ("2026-03-16", 0), ("2026-03-17", 1), ("2026-02-31", 1), ("xx", 3)])
def test_weekday(spark, iso, day):
    assert value(spark, X.weekday(F.lit(iso))) == day


def test_dates(spark):
    assert value(spark, X.epoch_seconds(F.lit("1970-01-02T00:00:01Z"))) == 86401
    assert value(spark, X.epoch_days(F.lit("2026-02-31T00:00:00Z"))) == value(spark, X.epoch_days(F.lit("2026-03-03T00:00:00Z")))
    assert value(spark, X.minutes_between(F.lit("2026-03-11T00:01:01Z"), F.lit("2026-03-11T00:00:00Z"))) == -1
    assert value(spark, X.digits(F.lit("12a4"), 0, 4)) is None


def test_clamp_and_quantize(spark):
    for x, y in ((-1.0, 0.0), (0.0, 0.0), (0.5, 0.5), (1.0, 1.0), (1.5, 1.0)):
        assert value(spark, X.clamp01(F.lit(x))) == y
    nan = value(spark, X.clamp01(F.lit(float("nan"))))
    assert nan != nan
    for x, y in ((-1.0, -10000), (0.0, 0), (1.0, 10000), (0.5, 5000), (9.0, 32767), (-9.0, -32768), (float("nan"), 0), (0.00005, 1), (-0.00005, -1)):
        assert value(spark, V.quantize(F.lit(x).cast("float"))) == y


def test_distances(spark):
    zero, one = (F.array(*[F.lit(x)] * 14) for x in (0, 1))
    assert value(spark, V.squared_distance(V.columns(zero, 14), V.columns(one, 14))) == 14
    assert value(spark, V.first_greatest(F.array(F.lit(1), F.lit(7), F.lit(7)))) == 1
    assert value(spark, V.align_up(F.lit(7), 8)) == 8 and value(spark, V.align_up(F.lit(3), 8)) == 8


def test_lenient_seconds_agree_with_the_usual_form(spark):
    days = ["2026-03-11", "2024-02-29", "1900-01-01", "0001-01-01", "9999-12-31"]
    for d in days:
        text = f"{d}T23:59:58Z"
        assert value(spark, X.epoch_seconds(F.lit(text))) == value(spark, X.epoch_seconds(F.lit(text.replace("Z", "")))), d
    assert value(spark, X.epoch_seconds(F.lit("2026-02-31T00:00:61Z"))) == value(spark, X.epoch_seconds(F.lit("2026-03-03T00:00:59Z")))


def test_refused_payloads(spark):
    bad = payload()
    del bad["merchant"]["mcc"]
    lines = spark.createDataFrame([(json.dumps(payload()),), (json.dumps(bad),), ("{not json",), (None,), (json.dumps(payload(transaction__installments=-1)),)], "value string")
    good, refused = parse_payloads(lines)
    assert good.count() == 1 and refused.count() == 4
