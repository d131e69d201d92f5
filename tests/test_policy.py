import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from quietspan.operators import spans as S
from quietspan.plans import policy as L
from quietspan.sources import files
from quietspan.streaming import decisions

P1, P2 = L.Policy("1"), L.Policy("2", many=2)


@pytest.fixture()
def items(spark):
    rows = [(1, "a", "card 4242424242424242"), (2, "a", "none"), (3, "b", "4242424242424242 4000002500003155"), (4, "b", None)]
    return spark.createDataFrame(rows, "item_id long, account_id string, text string").withColumn("spans", S.card_spans(F.col("text")))


def actions(df):
    return {r.item_id: r.action for r in df.collect()}


def test_decide(items):
    out = L.with_decision(items, P1)
    assert actions(out) == {1: "mask", 2: "allow", 3: "mask", 4: "quarantine"}
    shown = {r.item_id: r.output for r in out.collect()}
    assert shown == {1: "card [CREDIT_CARD_1]", 2: "none", 3: "[CREDIT_CARD_1] [CREDIT_CARD_2]", 4: None}


def test_defects_and_suspicions_only_raise(items):
    d = items.withColumns({"defects": F.expr("if(item_id = 2, array('X'), cast(array() as array<string>))"), "anomalies": F.expr("if(item_id = 1, array('hidden_css:imperative'), array('hidden_css:identifier_shaped'))")})
    assert actions(d.withColumn("action", L.decide(F.col("spans"), P1, F.col("defects"), F.col("anomalies")))) == {1: "quarantine", 2: "quarantine", 3: "mask", 4: "quarantine"}


def test_unknown_detector_gets_the_default(spark):
    df = spark.sql("select array(named_struct('detector', 'new', 'start', 0, 'end', 1, 'text', 'x')) as s")
    assert df.select(L.decide(F.col("s"), P1)).first()[0] == "quarantine"


def test_shadow_diff_and_counts(items):
    old, new = (L.with_decision(items, p) for p in (P1, P2))
    assert [tuple(r) for r in L.shadow_diff(old, new).collect()] == [("mask", "quarantine", 1)]
    assert {(r.account_id, r.action): r.n for r in L.withheld_counts(old, "account_id").collect()} == {("a", "mask"): 1, ("a", "allow"): 1, ("b", "mask"): 1, ("b", "quarantine"): 1}


def test_reports_hold_no_text(items):
    out = L.with_decision(items, P1)
    for mode in ("out_of_band", "counts_only", "in_band"):
        assert not {"text", "output", "spans"} & set(L.report(out, mode).columns)
    assert {r.reason for r in L.report(out, "in_band").collect()} == {"sensitive", "failed_scan"}
    assert {r.reason for r in L.report(out, "in_band", "fine").collect()} == {"credit_card", None}
    with pytest.raises(ValueError):
        L.report(out, "other")


def test_cache(spark, items):
    keyed = L.cache_key(items.select("item_id", "text"), P1, "1")
    now = F.to_timestamp(F.lit("2026-01-31"))
    rows = keyed.where("item_id <= 2").select(*L.CACHE_KEY, F.lit("mask").alias("action"), F.expr("if(item_id = 1, timestamp '2026-01-30', timestamp '2025-01-01')").alias("at"))
    cache = L.fresh(rows, now)
    assert [r.item_id for r in L.hits(keyed, cache).collect()] == [1]
    assert sorted(r.item_id for r in L.misses(keyed, cache).collect()) == [2, 3, 4]
    assert L.misses(L.cache_key(items, P2, "1"), cache).count() == 4


def test_narrowing_never_loosens(spark):
    df = spark.createDataFrame([(p, n) for p in ("unspecified", "scheduling", "odd", None) for n in (0, 1, 2)], "p string, n int")
    for r in df.select("p", "n", L.narrow(F.col("p"), F.col("n")).alias("x")).collect():
        assert r.x >= r.n and (r.n == 0) == (r.x == 0)


def test_thresholds_and_refs(spark):
    df = spark.createDataFrame([(0.1,), (0.25,), (0.7,), (None,), (float("nan"),)], "c double")
    assert [r[0] for r in df.select(L.decide_by_confidence(F.col("c"))).collect()] == ["allow", "mask", "quarantine", "quarantine", "quarantine"]
    for key in (b"k", b"x" * 100):
        assert spark.range(1).select(L.hmac_ref(F.lit("id-é"), key)).first()[0] == hmac.new(key, "id-é".encode(), hashlib.sha256).hexdigest()


def test_truncate_scope_rules(items, spark):
    page, info = L.truncate(items, [F.col("item_id")], 3)
    assert page.count() == 3 and info.first().total == 4 and info.first().truncated
    assert L.scoped(items, "a").count() == 2
    rules = spark.createDataFrame([("*@bank.example", "quarantine"), ("a_*", "mask")], "pattern string, action string")
    mails = spark.createDataFrame([(1, "X@Bank.example"), (2, "a_b"), (3, "axb")], "item_id long, sender string")
    assert actions(L.matching_rules(mails, rules)) == {1: "quarantine", 2: "mask", 3: "allow"}


def test_audit_has_no_text(items, tmp_path, spark):
    out = L.cache_key(L.with_decision(items, P1), P1, "1").withColumn("at", F.current_timestamp())
    files.write_audit(out, str(tmp_path / "audit"))
    assert set(spark.read.parquet(str(tmp_path / "audit")).columns) <= set(files.AUDIT_COLUMNS)
    files.write_spans(out.select("item_id", "spans"), str(tmp_path / "spans"))
    assert spark.read.parquet(str(tmp_path / "spans")).columns == ["item_id", "detector", "start", "end"]


def test_stream_equals_batch_and_replays_add_nothing(spark, tmp_path, items):
    folder, table = str(tmp_path / "in"), str(tmp_path / "out")
    source = items.select("item_id", "text").repartition(2)
    source.write.parquet(folder)
    for k in range(2):
        stream = decisions.follow(spark, folder, source.schema)
        decisions.start(stream, table, str(tmp_path / f"cp{k}"), P1).awaitTermination()
        got = spark.read.parquet(table)
        want = decisions.scan(source, P1, "1")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_rules_over_the_bound_fail(spark):
    mails = spark.createDataFrame([(1, "a@b.example")], "id int, sender string")
    rules = spark.range(10_001).select(F.concat(F.col("id").cast("string"), F.lit("@x.example")).alias("pattern"), F.lit("mask").alias("action"))
    with pytest.raises(ValueError, match="10,000 rules"):
        L.matching_rules(mails, rules)
