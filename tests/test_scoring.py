import pytest
from pyspark.sql import functions as F

from spanframe.model import GOLD
from spanframe.operators import relational, scoring
from spanframe.operators import tokens as T


def frames(spark, gold, preds):
    g = spark.createDataFrame(gold, GOLD)
    p = spark.createDataFrame(preds, "system string, " + "id string, spans array<struct<start:int,end:int,label:string>>")
    return scoring.join_predictions(g, p, spark.createDataFrame([("s",)], "system string"))


def test_rates_and_micro(spark):
    joined = frames(spark, [("a", "x" * 20, [(0, 3, "PERSON"), (5, 9, "ORG")], "easy")], [("s", "a", [(0, 3, "PERSON"), (0, 3, "PERSON")])])
    by = {(r.rule, r.label): r for r in scoring.score_by_label(scoring.row_counts(joined)).collect()}
    person, micro = by["exact", "PERSON"], by["exact", "micro"]
    assert (person.precision, person.recall, person.f1) == (0.5, 1.0, 0.6667)
    assert (micro.tp, micro.fp, micro.fn) == (1, 1, 1)
    assert by["overlap", "ADDRESS"].f1 == 0.0


def test_negatives_count_rows_and_any_label(spark):
    joined = frames(spark, [(x, "t", [], "negative") for x in "abc"], [("s", "a", [(0, 1, "OTHER"), (0, 1, "ORG")])])
    r = scoring.negatives(joined).first()
    assert (r.n, r.fired, r.fpr) == (3, 1, 0.3333)


def test_false_entities(spark):
    r = scoring.false_per_1000(frames(spark, [("a", "x" * 10, [], "negative")], [("s", "a", [(0, 1, "ORG"), (2, 3, "PERSON"), (4, 5, "OTHER")])])).first()
    assert r.false_per_1000 == 200.0


def test_every_tier_is_there(spark):
    joined = frames(spark, [("a", "t", [(0, 1, "ORG")], "easy")], [])
    tiers = {(r.rule, r.tier): r.f1 for r in scoring.score_by_tier(scoring.row_counts(joined)).collect()}
    assert len(tiers) == 6 and set(tiers.values()) == {0.0}


@pytest.mark.parametrize(("share", "value"), [(0.5, 30.0), (0.0, 10.0), (1.0, 50.0), (0.95, 48.0)])
def test_percentile(spark, share, value):
    df = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50)], "x double")
    assert df.agg(scoring.percentile_or(F.col("x"), share, F.lit(0.0)).alias("p")).first().p == value
    assert df.where("x < 0").agg(scoring.percentile_or(F.col("x"), share, F.lit(0.0)).alias("p")).first().p == 0.0


def test_latency_leaves_the_warm_up_out(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(14)] + [("t", 0, 5.0)], "system string, ord int, ms double")
    by = {r.system: r for r in scoring.latency_summary(df).collect()}
    assert (by["s"].n, by["s"].p50, by["s"].warmup) == (4, 11.5, 10)
    assert (by["t"].n, by["t"].p50, by["t"].warmup) == (0, 0.0, 1)


def test_run_summary(spark):
    rows = [("m", "4g", 10.0, 1.0, [1.0, 2.0], None, None), ("m", "4g", 30.0, 3.0, [3.0], None, False), ("m", "4g", 99.0, 9.0, [9.0], "boom", None), ("m", "3g", None, None, None, None, True)]
    df = spark.createDataFrame(rows, "model string, condition string, cold_load_ms double, first_inference_ms double, latencies_ms array<double>, error string, timed_out boolean")
    by = {r.condition: r for r in scoring.run_summary(df).collect()}
    assert (by["4g"].ok_run_count, by["4g"].cold_load_ms_median, by["4g"].latency_p50, by["4g"].latency_n) == (2, 20.0, 2.0, 3)
    assert (by["3g"].ok_run_count, by["3g"].cold_load_ms_median, by["3g"].latency_n) == (0, None, None)


def test_parity_and_order_of_unknown_texts(spark):
    left = spark.createDataFrame([("a", "t", [1]), ("b", "t", [2]), ("c", "u", [3])], "id string, source string, input_ids array<int>")
    right = spark.createDataFrame([("a", [1]), ("b", [9])], "id string, input_ids array<int>")
    assert {r.source: (r.total, r.matches) for r in T.parity(left, right).collect()} == {"t": (2, 1), "u": (1, 0), "all": (3, 1)}
    dump = spark.createDataFrame([(0, [(0, 1, "y"), (1, 2, "x")]), (1, [(0, 1, "x"), (1, 2, "y")])], "ord int, unk_char_spans array<struct<start:int,end:int,text:string>>")
    assert [tuple(r) for r in T.top_unknown(dump).collect()] == [("y", 2), ("x", 2)]


def test_upsert_append_and_sections(spark):
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, relational.upsert(old, new, "k", ["v"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    twice = relational.append_runs(relational.append_runs(old, new, "k"), new, "k")
    assert twice.count() == 3
    lines = spark.createDataFrame([("f", 0, "x"), ("f", 1, "# a"), ("f", 2, "y")], "form string, number int, text string")
    heading = F.when(F.col("text").startswith("#"), F.col("text"))
    assert [r.section for r in relational.sections(lines, heading, "form").orderBy("number").collect()] == [None, "# a", "# a"]
    assert relational.first_known(spark.createDataFrame([(None, 0), ("z", 1)], "f string, rank int"), "f").first().f == "z"
