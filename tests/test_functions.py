import random
import re

import pytest
from pyspark.sql import functions as F

from spanframe.functions import match as M
from spanframe.functions import spans as S
from spanframe.functions import text as X
from spanframe.functions import tokens as K
from spanframe.functions.arrays import running_sums
from spanframe.model import SPANS
from spanframe.operators.responses import located_responses


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first().x


def surfaces(spark, text):
    return [(text[s.start : s.end], s.label) for s in one(spark, text, S.pattern_spans(F.col("text")))]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("姓名：林知遠。", [("林知遠", "PERSON")]),
        ("王先生您好，這是您的收據。", [("王先生", "PERSON")]),
        ("本案由誠信協會處理。", [("本案由誠信協會", "ORG")]),
        ("陳家先生在此。", [("陳家先", "PERSON")]),
        ("住址：高雄市三民區建國路３段８號。", [("高雄市", "PERSON"), ("高雄市三民區建國路３段８號", "ADDRESS")]),
        ("", []),
    ],
)
def test_patterns(spark, text, found):
    assert surfaces(spark, text) == found


def test_finding_agrees_with_the_standard_engine(spark):
    rng = random.Random(5)
    alphabet = "王李先生台北市區路號協會誠信，。 　\n😀ab1"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(600)]
    patterns = {"PERSON": S.person_pattern(), "ADDRESS": S.address_pattern(), "ORG": S.org_pattern()}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for label, pattern in patterns.items():
        plain = re.compile(pattern.removeprefix("(?U)"))
        for r in df.select("i", S.find_spans(F.col("text"), pattern, label).alias("s")).collect():
            assert [(s.start, s.end) for s in r.s] == [m.span() for m in plain.finditer(texts[r.i])], texts[r.i]


def python_greedy(gold, preds, rule):
    left, tp = list(preds), 0
    for g in gold:
        for p in left:
            if (g[:2] == p[:2]) if rule == "exact" else (g[0] < p[1] and p[0] < g[1]):
                left.remove(p)
                tp += 1
                break
    return tp, len(left), len(gold) - tp


def test_greedy_matching_agrees_with_plain_code(spark):
    rng = random.Random(7)
    spans = lambda: [(a, a + rng.randint(1, 6), "ORG") for a in [rng.randint(0, 12) for _ in range(rng.randint(0, 4))]]
    rows = [(i, spans(), spans()) for i in range(500)]
    df = spark.createDataFrame(rows, f"i int, g {SPANS}, p {SPANS}")
    for rule in M.MATCHERS:
        for r in df.select("i", M.greedy_match(F.col("g"), F.col("p"), rule).alias("c")).collect():
            assert tuple(r.c) == python_greedy(rows[r.i][1], rows[r.i][2], rule)


def test_wide_prediction_claims_one_gold_span_only(spark):
    df = spark.createDataFrame([([(0, 9, "ADDRESS"), (10, 19, "ADDRESS")], [(0, 19, "ADDRESS")])], f"g {SPANS}, p {SPANS}")
    assert tuple(df.select(M.greedy_match(F.col("g"), F.col("p"), "overlap").alias("c")).first().c) == (1, 0, 1)


def test_text(spark):
    assert one(spark, "a 1!~", X.to_fullwidth(F.col("text"))) == "ａ　１！～"
    assert one(spark, "ａ　１", X.to_halfwidth(F.col("text"))) == "a 1"
    assert one(spark, " \t您好，a.b!", X.strip_punctuation(F.col("text"))) == "您好ab"
    assert [one(spark, t, X.strip_marker(F.col("text"))) for t in ("##明", "▁a", "####", "a##")] == ["明", "a", "##", "a##"]
    assert one(spark, "　a  b\n", X.collapse_space(F.col("text"))) == "a b"
    dates = ("2024-02-29", "2023-02-29", "2024-2-1", "2024-01-01\n", "", None)
    assert [one(spark, d, X.is_calendar_date(F.col("text"))) for d in dates] == [True, False, False, False, False, False]
    assert [one(spark, "x", X.half_even(F.lit(v))) for v in (0.03125, 0.66665)] == [round(0.03125, 4), round(0.66665, 4)]
    assert one(spark, "easy=80,hard = 3", X.tier_counts(F.col("text"))) == {"easy": 80, "hard": 3}
    with pytest.raises(Exception, match="invalid tier count"):
        one(spark, "easy", X.tier_counts(F.col("text")))


def located(spark, text, items):
    response = '{"spans":[' + ",".join(f'{{"text":"{t}","label":"{label}"}}' for t, label in items) + "]}"
    r = located_responses(spark.createDataFrame([("a", text, response)], "id string, text string, response string")).first()
    return [text[s.start : s.end] for s in r.spans], (r.unlocated, r.relocated, r.ignored)


def test_locating(spark):
    assert located(spark, "陳彥今天來過，陳彥留下聯絡方式。", [("陳彥", "PERSON")] * 2) == (["陳彥", "陳彥"], (0, 0, 0))
    assert located(spark, "陳彥的鄰居是林小華。", [("林小華", "PERSON"), ("陳彥", "PERSON")]) == (["陳彥", "林小華"], (0, 1, 0))
    assert located(spark, "陳彥報案。", [("陳彥", "PERSON")] * 2) == (["陳彥"], (0, 1, 0))
    assert located(spark, "陳彥報案。", [("", "PERSON"), ("王" * 101, "PERSON"), ("李四", "ORG")]) == ([], (1, 0, 2))


def test_bad_items_cost_only_themselves(spark):
    response = '{"spans":["a",{"text":"陳","label":"OTHER"},{"label":"ORG"},{"text":7,"label":"ORG"}]}'
    rows = [("a", "陳7", response), ("b", "x", "not json"), ("c", "x", "{}"), ("d", None, None)]
    found = {r.id: r for r in located_responses(spark.createDataFrame(rows, "id string, text string, response string")).collect()}
    assert [(s.start, s.end) for s in found["a"].spans] == [(1, 2)]
    assert [found[x].failed for x in "abcd"] == [False, True, False, True]


def test_forms_and_marks(spark):
    text = "應徵者吳詠投遞了誠信診所的職缺。"
    spans = F.array(*[S.span_struct(F.lit(a), F.lit(b), F.lit(x)) for a, b, x in ((8, 12, "ORG"), (3, 5, "PERSON"))])
    assert one(spark, text, S.mark_spans(F.col("text"), spans)) == "應徵者⟦吳詠⟧投遞了⟦誠信診所⟧的職缺。"
    form = lambda label, surface: one(spark, surface, S.span_form(F.lit(label), F.col("text")))
    assert [form("PERSON", x) for x in ("吳詠", "吳詠恩", "吳先生", "吳詠小姐")] == ["PERSON: 2-character name", "PERSON: 3-character name", "PERSON: surname + honorific", "PERSON: full name + honorific"]
    assert [form("ADDRESS", x)[9:] for x in ("台北市大安區", "台北市大安區信義路1段2號", "台北市大安區信義路１段２號")] == ["city and district only", "street, ASCII digits", "street, fullwidth digits"]
    problem = lambda t, *s: one(spark, t, S.display_problem(F.col("text"), F.array(*[S.span_struct(F.lit(a), F.lit(b), F.lit("ORG")) for a, b in s]).cast(SPANS)))
    assert [problem("abc"), problem("a⟦"), problem("abc", (0, 2), (1, 3)), problem("abc", (1, 1)), problem("abc", (2, 4)), problem("abc", (0, 1), (1, 3))] == [None, "markup", "span", "span", "span", None]


def python_rebuild(text, tokens, unknown=("[UNK]", "<unk>")):
    bare = lambda t: re.sub("^(##|▁)", "", t)
    out, at = [], 0
    for i, t in enumerate(tokens):
        if t in unknown:
            nxt = -1
            for other in tokens[i + 1 : i + 3]:
                if other in unknown:
                    break
                if bare(other):
                    nxt = text.find(bare(other), at)
                    break
            end = nxt if nxt > at else min(at + 1, len(text))
            out.append((at, end))
            at = end
        elif not bare(t):
            out.append((at, at))
        elif (k := text.find(bare(t), at)) < 0:
            out.append(None)
            at = len(text)
        else:
            at = k + len(bare(t))
            out.append((k, at))
    return out


def test_rebuilt_offsets_agree_with_plain_code(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choices("王a 1😀明", k=rng.randint(0, 12))), rng.choices(["[UNK]", "<unk>", "王", "##明", "▁a", "▁", "1", "zz"], k=rng.randint(0, 8))) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, text string, tokens array<string>")
    for r in df.select("i", K.rebuild_offsets(F.col("text"), F.col("tokens")).alias("o")).collect():
        assert [None if o is None else (o.start, o.end) for o in r.o] == python_rebuild(*rows[r.i][1:]), rows[r.i]


def test_normalisation_keeps_length(spark):
    assert one(spark, "Ａ１", K.normalised_or_plain(F.col("text"))) == "A1"
    assert one(spark, "①㍿", K.normalised_or_plain(F.col("text"))) == "①㍿"


@pytest.mark.parametrize("n", [0, 1, 64, 65, 4096, 10_001])
def test_running_sums(spark, n):
    numbers = F.expr(f"transform(sequence(1, {max(n, 1)}), i -> cast(i % 7 as int))") if n else F.array().cast("array<int>")
    found = spark.range(1).select(running_sums(numbers).alias("s")).first().s
    want, total = [], 0
    for i in range(1, n + 1):
        total += i % 7
        want.append(total)
    assert found == want


def test_many_matches_in_one_text(spark):
    text = "é1\x01 " * 100_000
    found = spark.createDataFrame([(text,), (None,), ("",)], "text string").select(S.find_matches(F.col("text"), "[é1]+").alias("m")).collect()
    assert len(found[0].m) == 100_000 and tuple(found[0].m[-1]) == (399_996, 399_998, "é1") and [r.m for r in found[1:]] == [[], []]


def test_overlapping_spans_in_the_row(spark):
    spans = [(5, 9, "a"), (0, 6, "b"), (9, 10, "c"), (1, 2, "d"), (8, 12, "e")]
    df = spark.createDataFrame([(spans,), ([],)], f"spans {SPANS}")
    assert [[tuple(s) for s in r.x] for r in df.select(S.overlapping(F.col("spans")).alias("x")).collect()] == [[(1, 2, "d"), (5, 9, "a"), (8, 12, "e"), (9, 10, "c")], []]
