import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quietspan.functions import checksums as C
from quietspan.functions import patterns as P
from quietspan.operators import spans as S
from tests import checker


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i long, t string")


def spans(spark, texts, detect):
    rows = frame(spark, texts).select("i", detect(F.col("t")).alias("s")).collect()
    return {r.i: None if r.s is None else [(x.start, x.end) for x in r.s] for r in rows}


PINNED = [
    ("4242424242424242 349.00", [(0, 16)]),
    ("0000 0000 1111 3388 1", [(0, 19)]),
    ("4242\n424242424242", []),
    ("4" * 25, []),
    ("４２" * 8, [(0, 16)]),
    ("x\U0001f600 4242‐4242−4242　4242!", [(3, 22)]),
    ("4242–4242–4242–4242", []),
    ("", []),
    ("4242-4242-4242-4242 and 4000 0025 0000 3155", [(0, 19), (24, 43)]),
]


def test_cards_pinned(spark):
    got = spans(spark, [t for t, _ in PINNED], S.card_spans)
    assert [got[i] for i in range(len(PINNED))] == [s for _, s in PINNED]


def test_null_text_is_a_failed_scan(spark):
    assert spans(spark, [None], S.card_spans) == {0: None}
    row = frame(spark, [None]).select(S.iban_scan(F.col("t")).alias("s")).first().s
    assert row.status == "error" and row.spans is None


def test_card_span_text_is_the_slice(spark):
    texts = [t for t, _ in PINNED]
    for r in frame(spark, texts).select("i", F.explode(S.card_spans(F.col("t"))).alias("s")).collect():
        assert texts[r.i][r.s.start : r.s.end] == r.s.text and r.s.detector == "credit_card"


def test_many_groups_neither_overflow_nor_miss(spark):
    text = "1 " * 1500 + "x 4242424242424242"
    assert spans(spark, [text], S.card_spans)[0][-1] == (3002, 3018)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789 -. \nxAé😀", max_size=60), min_size=30, max_size=60))
def test_cards_against_checker(spark, texts):
    rnd = random.Random(len(texts))
    texts = texts + ["".join(rnd.choice("0123456789 -") for _ in range(40)) for _ in range(60)]
    got = spans(spark, texts, S.card_spans)
    assert [got[i] for i in range(len(texts))] == [checker.cards(t) for t in texts]


def account(country, rnd):
    body = "".join(rnd.choice("0123456789") for _ in range(P.IBAN_LENGTH[country] - 4))
    digits = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{body}"


def test_every_country_is_found_and_near_misses_are_not(spark):
    rnd = random.Random(1)
    good = [account(c, rnd) for c in sorted(P.IBAN_LENGTH)]
    assert len(good) == 89
    spaced = [" ".join(a[i : i + 4] for i in range(0, len(a), 4)) for a in good]
    texts = [f"to {a}, now" for a in good + spaced] + [a.lower() for a in good] + [f"x{a}" for a in good] + [f"{a}9" for a in good] + [a[:-1] for a in good]
    texts += [a[:2] + f"{(int(a[2:4]) + 5) % 100:02d}" + a[4:] for a in good]
    got = spans(spark, texts, S.iban_spans)
    assert [got[i] for i in range(len(texts))] == [checker.ibans(t) for t in texts]
    assert all(got[i] == [(3, 3 + len(texts[i]) - 8)] for i in range(2 * len(good)))


def test_letter_adjacent_grouping_fails_the_scan(spark):
    assert spans(spark, ["GB82 WEST 1234 5698 7654 32", "BE16 a b c d e f g h i j k l"], S.iban_spans) == {0: None, 1: None}


def test_checksums(spark):
    rows = [("79927398713", True), ("79927398710", False), ("", False)]
    got = frame(spark, [d for d, _ in rows]).select("i", C.luhn(F.col("t")).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [ok for _, ok in rows]
    got = frame(spark, ["GB82WEST12345698765432", "GB82WEST12345698765431", "gb82west12345698765432", "DE1"]).select("i", C.mod97(F.col("t")).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [True, False, None, None]
    got = frame(spark, ["86095742719", "86095742718", "12345678901", "0", None]).select("i", C.mod11_10(F.col("t")).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [True, False, False, False, False]


def test_tax_ids(spark):
    assert spans(spark, ["id 86095742719.", "x86095742719", "860957427190"], S.tax_id_spans) == {0: [(3, 14)], 1: [], 2: []}


@pytest.mark.parametrize("text", ["a 4242424242424242 b 4242424242424242 c 4000002500003155"])
def test_mask_numbers_distinct_values(spark, text):
    df = frame(spark, [text]).withColumn("s", S.card_spans(F.col("t")))
    assert df.select(S.mask(F.col("t"), F.col("s"))).first()[0] == "a [CREDIT_CARD_1] b [CREDIT_CARD_1] c [CREDIT_CARD_2]"


def test_merge_keeps_the_longest(spark):
    df = frame(spark, ["DE89370400440532013000"]).select(S.merge_spans(S.iban_spans(F.col("t")), S.card_spans(F.col("t"))).alias("s"))
    assert [(x.detector, x.start, x.end) for x in df.first().s] == [("iban", 0, 22)]
