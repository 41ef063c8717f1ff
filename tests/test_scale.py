"""What keeps tasks short and rows made once, by the plans of the queries."""

import random

import compare
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanframe import queries as own
from spanframe.functions import match, spans
from spanframe.functions import tokens as K
from spanframe.functions.batches import span_lists
from spanframe.operators import tokens

SF = f"{compare.DATA}/sf0.001"


def plan(spark, name):
    return own.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_grow_in_number_not_in_length(spark):
    cores = spark.sparkContext.defaultParallelism
    keys = own.spread(spark.range(0, own.KEYS_A_TASK * (cores + 2), 1, cores))
    sizes = keys.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == cores + 2 and max(sizes) <= 1.1 * own.KEYS_A_TASK


@pytest.mark.parametrize("name", ["rebuilt_mismatches", "rebuilt_accuracy"])
def test_offsets_are_rebuilt_without_a_fold_of_columns(spark, name):
    assert "locate(" not in plan(spark, name) and "concat(" not in plan(spark, name)


def test_tiers_are_filled_from_sums_and_not_from_the_rows_once_more(spark):
    assert plan(spark, "score_tiers").count("Relation [") == 1


@pytest.mark.parametrize("name", ["overlap_check", "regex_spans", "span_counts_by_label"])
def test_a_pattern_is_no_fold_of_columns(spark, name):
    assert "regexp_replace(" not in plan(spark, name)


@pytest.mark.parametrize("name", ["score_labels", "false_entities_per_1000", "system_scores"])
def test_spans_are_matched_without_folds_of_columns(spark, name):
    assert "array_position(" not in plan(spark, name)


def test_a_form_is_checked_in_its_row(spark):
    found = plan(spark, "audit_forms")
    assert "Join" not in found and "Window" not in found and "Aggregate" not in found


@pytest.mark.parametrize("name", ["locate_spans", "token_masks"])
def test_a_filter_or_lambda_makes_no_sentence_again(spark, name):
    found = plan(spark, name)
    assert found.count("MapInArrow") == 1 and "您好，我是" not in found


def test_rebuilt_offsets_are_counted_without_lambdas(spark):
    found = plan(spark, "rebuilt_accuracy")
    assert "lambdafunction(" not in found and found.count("MapInArrow") == 2


@pytest.mark.parametrize("pairs", [1, 7, 1 << 22])
def test_rebuilt_counts_agree_with_plain_code(monkeypatch, pairs):
    rng = random.Random(5)
    number = lambda: rng.choice([None, *range(6), *range(6)])
    struct = lambda: None if rng.random() < 0.1 else {"start": number(), "end": number()}
    lists = lambda n: [struct() for _ in range(n)]
    sizes = [rng.choice([0, 1, 2, 5, 9]) for _ in range(400)]
    truth = [lists(n) for n in sizes]
    rebuilt = [[rng.choice([t, t, struct()]) for t in row] for row in truth]
    entities = [None if rng.random() < 0.1 else lists(rng.randrange(4)) for _ in sizes]
    under = lambda a, b: a is not None and b is not None and a < b
    expected = []
    for r, t, es in zip(rebuilt, truth, entities, strict=True):
        hits = [[i for i, o in enumerate(t) if o and e and under(o["start"], e["end"]) and under(e["start"], o["end"])] for e in es or []]
        edge = lambda i, c: r[i] and r[i][c]  # noqa: B023, E731
        right = [bool(h) and e["start"] is not None and edge(h[0], "start") == e["start"] and edge(h[-1], "end") == e["end"] for h, e in zip(hits, es or [], strict=True)]
        known = es is not None or not t
        expected.append((len(t), sum(a == b for a, b in zip(r, t, strict=True)), sum(map(bool, hits)) if known else None, sum(right) if known else None))
    monkeypatch.setattr(tokens, "PAIRS", pairs)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    counts, unknown = tokens._right_counts(*(pa.array(x, kind) for x in (rebuilt, truth, entities)))
    found = [(a, b, None if u else c, None if u else d) for a, b, c, d, u in zip(*map(list, counts), list(unknown), strict=True)]
    assert found == expected


def test_uneven_rows_are_left_out_of_rebuilt_accuracy(spark):
    kind = "array<struct<start:int,end:int>>"
    one, two = [(0, 1)], [(0, 1), (1, 2)]
    rows = [("a", two, two, [(0, 2)]), ("a", one, two, [(0, 2)]), ("a", None, two, []), ("a", [None, (1, 3)], [None, (1, 2)], None), ("b", one, two, [(0, 1)])]
    found = tokens.rebuilt_accuracy(spark.createDataFrame(rows, f"tokenizer string, rebuilt {kind}, truth {kind}, entities {kind}"))
    assert sorted(map(tuple, found.collect())) == [("a", 4, 1, 4, 3, 1, 1, 0.75, 1.0), ("b", 1, 1, None, None, None, None, None, None)]


@pytest.mark.parametrize("name", ["system_scores", "system_negatives"])
def test_predictions_are_made_in_one_pass_and_never_broadcast(spark, name):
    found = own.QUERIES[name](spark, SF)._jdf.queryExecution()
    # the scan of the names of systems, which system_negatives is not given, is a job of its own
    assert found.optimizedPlan().toString().count("MapInArrow") == 2
    assert "Broadcast" not in found.executedPlan().toString() and "SortMergeJoin" in found.executedPlan().toString()


def test_organizations_are_looked_for_only_where_a_suffix_is(monkeypatch):
    monkeypatch.setattr(spans, "org_pattern", lambda **_: "x")
    assert spans.pattern_finder()("x") == [] and spans.pattern_finder()("x銀行") == [(0, 1, "ORG")]


@pytest.mark.parametrize("nulls", [False, True])
@pytest.mark.parametrize("rules", [("exact", "overlap"), ("exact",)])
def test_counts_of_batches_agree_with_those_of_rows(nulls, rules):
    rng = random.Random(7)
    number = lambda: None if nulls and rng.random() < 0.1 else rng.randrange(5)
    label = lambda: rng.choice(["PERSON", "PERSON", "ADDRESS", "ORG", "OTHER", None if nulls else ""])
    side = lambda: [None if nulls and rng.random() < 0.1 else [(number(), number(), label()) for _ in range(rng.choice([0, 1, 1, 2, 3, 6]))] for _ in range(500)]
    gold, found = side(), side()
    names = [f.name for f in match._COUNTS]
    expected = [[dict(zip(names, x, strict=True)) for x in match._row_counts(g, p, rules)] for g, p in zip(gold, found, strict=True)]
    assert match._batch_counts(span_lists(gold), span_lists(found), rules).to_pylist() == expected


def test_plain_batches_are_not_counted_row_by_row(monkeypatch):
    monkeypatch.delattr(match, "_row_counts")
    rows = span_lists([[(0, 2, "ORG"), (3, 5, "PERSON")], []])
    assert [[(c["label"], c["tp"], c["fp"], c["fn"]) for c in r if c["tp"]] for r in match._batch_counts(rows, rows, ("exact",)).to_pylist()] == [[("PERSON", 1, 0, 0), ("ORG", 1, 0, 0)], []]


def test_masks_are_applied_without_a_lambda_a_token(spark):
    found = plan(spark, "token_masks")
    assert "zip_with(" not in found and "sequence(" not in found and "filter(" not in found


def test_masks_and_unknown_tokens_of_odd_rows(spark):
    rows = [
        (["a", "[UNK]", "b"], [[0, 1], [1, 3], [3, 4]], [0, 0, 1]),
        (["[UNK]"], [[0, 2]], [0]),
        ([], [], []),
        (["a", None, "[UNK]"], [[0, 1], None, None], [0, 0, None]),
        (["[UNK]", "[UNK]"], [[0, 1]], [0]),
        (["a"], [[0, 1], [1, 2]], [0, 0, 1]),
        (None, [], [0]),
        (["a"], None, None),
    ]
    kind = "tokens array<string>, offsets array<array<int>>, mask array<int>, i int"
    for parts in (rows[:3], rows):
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(parts)], kind).coalesce(1)
        one = df.select("i", K.content_tokens(F.col("tokens"), F.col("mask")).alias("c"), K.unknown_spans(F.lit("wxyz"), F.col("tokens"), F.col("offsets"), "[UNK]").alias("u"))
        found = [(r.c, r.u and [tuple(x) for x in r.u]) for r in one.orderBy("i").collect()]
        expected = [(["a", "[UNK]"], [(1, 3, "xy")]), (["[UNK]"], [(0, 2, "wx")]), ([], []), (["a", None], [(None, None, None)]), (["[UNK]"], [(0, 1, "w"), (None, None, None)]), (["a", None], []), (None, None), (None, None)]
        assert found == expected[: len(parts)]
