from pyspark.sql import functions as F

from quietspan.operators import spans as S
from quietspan.plans import corpus_qa as Q
from quietspan.plans import policy as L


def texts_of(spark, text, f):
    df = spark.createDataFrame([(text,)], "t string")
    return [s.text for s in df.select(f(F.col("t")).alias("s")).first().s]


def test_further_detectors(spark):
    assert texts_of(spark, "a 123-45-6789, 000-12-3456, 123-45-67890", S.ssn_spans) == ["123-45-6789"]
    assert texts_of(spark, "943 476 5919 and 9434765918", S.nhs_spans) == ["943 476 5919"]
    assert texts_of(spark, "15070649C103 15070649C104", S.pension_spans) == ["15070649C103"]
    assert texts_of(spark, "-----BEGIN PRIVATE KEY----- xoxb-1234567890-a AKIAAAAAAAAAAAAAAAA", S.secret_spans) == ["-----BEGIN PRIVATE KEY-----", "xoxb-1234567890-a"]


def test_residue_leaves_claimed_runs(spark):
    text = "x 000004242424242424242 y"
    free = lambda c: S.residue_spans(c, F.array().cast(f"array<{S.SPAN}>"))
    assert texts_of(spark, text, free) == ["4242424242424242"]
    claim = F.expr("array(named_struct('detector', 'iban', 'start', 2, 'end', 6, 'text', '0000'))").cast(f"array<{S.SPAN}>")
    assert texts_of(spark, text, lambda c: S.residue_spans(c, claim)) == []
    assert texts_of(spark, "4242424242424242", free) == []


def test_attachments(spark):
    df = spark.sql("SELECT 1 AS i, array(named_struct('scanned', true)) AS a UNION ALL SELECT 2, array(named_struct('scanned', cast(null AS boolean))) UNION ALL SELECT 3, cast(array() AS array<struct<scanned:boolean>>)")
    assert {r.i: r.x for r in df.select("i", L.attachment_action(F.col("a")).alias("x")).collect()} == {1: "allow", 2: "quarantine", 3: "allow"}


def test_schema_of_a_sound_file(spark):
    good = '{"expected_spans": [{"detector": "iban", "start": 0, "end": 2, "text": "x"}], "expected_action": "mask", "must_not_appear_in_output": ["x"], "expected_anomalies": [], "notes": "n"}'
    df = spark.createDataFrame([(good,), (None,), ("[]",)], "j string")
    assert [r[0] for r in df.select(Q.schema_violations(F.col("j"), Q.EXPECTATION)).collect()] == [[], ["$: type"], ["$: type"]]
