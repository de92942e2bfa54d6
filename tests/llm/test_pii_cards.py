"""Card numbers beside other numbers."""

import pytest
from pyspark.sql import functions as F
from test_text_operators import docs_of, luhn_ok

from knnscore.llm import pii

SOLID = "4111111111111111"
CARD = "4111 1111 1111 1111"
CASES = [  # text, texts around its card numbers
    (f"{CARD} 12/25", ["", " 12/25"]),
    (f"{SOLID} 123", ["", " 123"]),
    (f"qty 2 {CARD}", ["qty 2 ", ""]),
    (f"1234 {CARD}", ["1234 ", ""]),
    (f"12 34 {CARD} 56", ["12 34 ", " 56"]),
    (f"{CARD} 5500 0000 0000 0004", ["", " ", ""]),
    (f"{CARD} {CARD} {CARD} 7", ["", " ", " ", " 7"]),
    ("378282246310005 99", ["", " 99"]),
    (CARD.replace(" ", "-") + " 12", ["", " 12"]),
    ("1234 5678 9012 3456", ["1234 5678 9012 3456"]),
]


@pytest.fixture(scope="module")
def replaced(spark):
    rows = pii.pseudonymize(docs_of(spark, [t for t, _ in CASES]), "test key").collect()
    return {r.doc_id: r for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cards_beside_numbers(replaced, i):
    text, around = CASES[i]
    new, at = replaced[i].text, 0
    assert replaced[i].n_private == len(around) - 1 and len(new) == len(text)
    for k, fixed in enumerate(around):
        assert new[at : at + len(fixed)] == fixed
        at += len(fixed)
        if k < len(around) - 1:
            n = len(text[at:].split(around[k + 1])[0]) if around[k + 1].strip() else 19 if text[at + 4] in " -" else 16
            assert luhn_ok(new[at : at + n]) and new[at : at + n] != text[at : at + n]
            at += n


def test_values_after_cards(spark):
    text = f"{CARD} 10.0.0.255 {CARD} 123-45-6789 5 2020-01-31 12345"
    r = pii.pseudonymize(docs_of(spark, [text]), "test key").where(F.col("text").isNotNull()).first()
    assert r.n_private == 5
    for old in (CARD, "10.0.0.255", "123-45-6789", "2020-01-31"):
        assert old not in r.text
