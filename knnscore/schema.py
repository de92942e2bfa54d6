"""Schemas of the transactions, references, evaluation entries and decisions."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, StringType, StructType

DIMS = 14
_S, _F, _I, _B = StringType(), FloatType(), IntegerType(), BooleanType()


def _struct(**fields: DataType) -> StructType:
    out = StructType()
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out


PAYLOAD = _struct(
    id=_S,
    transaction=_struct(amount=_F, installments=_I, requested_at=_S),
    customer=_struct(avg_amount=_F, tx_count_24h=_I, known_merchants=ArrayType(_S)),
    merchant=_struct(id=_S, mcc=_S, avg_amount=_F),
    terminal=_struct(is_online=_B, card_present=_B, km_from_home=_F),
    last_transaction=_struct(timestamp=_S, km_from_current=_F),
)
REFERENCE = _struct(vector=ArrayType(_F), label=_S)
EVALUATION = _struct(entries=ArrayType(_struct(request=PAYLOAD, expected_approved=_B, expected_fraud_score=DoubleType())))
#: Fields without which a payload is refused.
REQUIRED = (
    "id", "transaction.amount", "transaction.installments", "transaction.requested_at", "customer.avg_amount", "customer.tx_count_24h",
    "customer.known_merchants", "merchant.id", "merchant.mcc", "merchant.avg_amount", "terminal.is_online", "terminal.card_present", "terminal.km_from_home",
)
