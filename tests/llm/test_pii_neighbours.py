"""Valid values next to more digits or capitals, which have a form together with them."""

from __future__ import annotations

import re

import pytest

from tests.llm.test_operators import luhn
from tracelode.llm import pii

CARD = "4111 1111 1111 1111"
LAYOUTS = [
    ("4111111111111111 12/26", ["4111111111111111"]),
    (f"{CARD} 123", [CARD]),
    (f"ids 12 {CARD}", [CARD]),
    (f"ref 1234 {CARD}", [CARD]),
    (f"12 34 {CARD} 5", [CARD]),
    (f"AB12 {CARD}", [CARD]),
    (f"{CARD} 10.0.0.1", [CARD, "10.0.0.1"]),
    (f"+44 20 7946 0958 {CARD}", ["+44 20 7946 0958", CARD]),
    (f"12345 123-45-6789 {CARD}", ["123-45-6789", CARD]),
    ("12345 2024-01-15 1", ["2024-01-15"]),
    ("BE68 5390 0754 7034 EUR", ["BE68 5390 0754 7034"]),
    ("ID12 BE68 5390 0754 7034", ["BE68 5390 0754 7034"]),
    ("ES91 2100 0418 4502 0005 1332 BBVA", ["ES91 2100 0418 4502 0005 1332"]),
    (f"BE68 5390 0754 7034 {CARD}", ["BE68 5390 0754 7034", CARD]),
    ("BE68 5390 0754 7034 BOB@mail.example", ["BE68 5390 0754 7034", "BOB@mail.example"]),
]


def test_values_beside_others(spark):
    table = spark.createDataFrame([(k, f"pay {t} now") for k, (t, _) in enumerate(LAYOUTS)], "doc_id int, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(table, "k").collect()}
    for k, (text, values) in enumerate(LAYOUTS):
        # Each value's place holds its pseudonym alone; all else stays.
        wanted = f"pay {text} now"
        assert got[k].n_replaced == len(values) == len(got[k].pseudonyms), (text, got[k])
        for value, new in zip(values, got[k].pseudonyms):
            assert new != value and len(new) >= 7
            wanted = wanted.replace(value, new, 1)
            if value == CARD:
                assert re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", new) and luhn(new.replace(" ", ""))
        assert got[k].text == wanted, (text, got[k])


@pytest.mark.parametrize("text", ["4366 8264 2204 3231 12/26", "DE00 3704 0044 0532 0130 00 EUR", "1 2 3 4 5 6"])
def test_invalid_ones_stay(spark, text):
    got = pii.pseudonymised(spark.createDataFrame([(1, text)], "doc_id int, text string"), "k").first()
    assert (got.text, got.n_replaced) == (text, 0)
