"""Registered queries over the driver's tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe import lexicon
from spanframe.functions import spans as S
from spanframe.functions import text as X
from spanframe.functions import tokens as K
from spanframe.functions.batches import list_array, offset_lists, values_of
from spanframe.model import LABELS, SPANS, dimension
from spanframe.operators import relational, responses, scoring
from spanframe.operators import tokens as T
from spanframe.plans import audit
from spanframe.plans.generate import KEYED, slot_sql, strip_sql, synthesize, template_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys of a task: what is made of a key costs far more than to move it, so tasks are many and short at any size.
KEYS_A_TASK = 50_000


def spread(keys: DataFrame) -> DataFrame:
    """keys dealt evenly over all cores and over so many tasks that each has few, however few and large the file's splits are."""
    cores = keys.sparkSession.sparkContext.defaultParallelism
    return keys.repartition(max(cores, -(-keys.count() // KEYS_A_TASK)))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled sentence an order."""
    return synthesize(spread(table(spark, sf_dir, "orders").select("o_orderkey")), "o_orderkey")


def _templates_sql() -> str:
    slot = lambda s: "NULL::VARCHAR" if s is None else f"'{s}'"
    parts = lambda ps: "[" + ", ".join(f"{{'literal': '{lit}', 'slot': {slot(s)}}}" for lit, s in ps) + "]"
    return ", ".join(f"('{tier}', {i}, '{name}', {parts(ps)})" for tier, i, name, ps in template_rows())


def corpus_sql() -> str:
    """CTEs that end in zh(k, id, text, tier, template_id, spans), spans a list of {start, end, label}."""
    sizes = {t: sum(r[0] == t for r in template_rows()) for t in ("easy", "medium", "hard", "negative")}
    size = "CASE tier " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in sizes.items()) + " END"
    slots = slot_sql()
    values = "CASE p.slot " + " ".join(f"WHEN '{s}' THEN v_{s}" for s in slots) + " ELSE '' END"
    return f"""
      t(tier, place, template_id, parts) AS (VALUES {_templates_sql()}),
      keys AS (SELECT o_orderkey AS k, ['easy', 'medium', 'hard', 'negative'][(o_orderkey % 4 + 1)::INT] AS tier FROM orders),
      placed AS (SELECT k, keys.tier, t.template_id, t.parts, {strip_sql("k", "keys.tier")} AS bare FROM keys
        JOIN t ON t.tier = keys.tier AND t.place = (keys.k // 4) % ({size.replace("tier", "keys.tier", 1)})),
      valued AS (SELECT *, {", ".join(f"{sql} AS v_{s}" for s, sql in slots.items())} FROM placed),
      filled AS (SELECT k, tier, template_id, list_transform(parts, lambda p: {{
        'literal': CASE WHEN bare THEN translate(p.literal, '{lexicon.STRIPPED}', '') ELSE p.literal END, 'slot': p.slot, 'value': {values}}}) AS f FROM valued),
      zh AS (SELECT k, concat(tier, '_', k) AS id, array_to_string(list_transform(f, lambda x: x.literal || x.value), '') AS text, tier, template_id,
        list_filter(list_transform(range(1, len(f) + 1), lambda i: {{
          'start': (coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y.literal) + length(y.value))), 0) + length(f[i].literal))::INT,
          'end': (coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y.literal) + length(y.value))), 0) + length(f[i].literal) + length(f[i].value))::INT,
          'label': f[i].slot}}), lambda s: s.label IN ('PERSON', 'ADDRESS', 'ORG')) AS spans FROM filled)"""


#: The negated class of the patterns for an engine whose \s knows ASCII only.
_OTHER = r"[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}" + lexicon.PUNCTUATION + "]"


def found_sql(source: str, pattern: str, text: str = "text") -> str:
    """A list of {start, end} of a pattern's matches in a column, by the lengths of matches and of what is between them."""
    return f"""
      SELECT *, list_transform(range(1, len(m) + 1), lambda i: {{
        's': (coalesce(list_sum(g[1:i]), 0) + coalesce(list_sum(m[1:i - 1]), 0))::INT,
        'e': (coalesce(list_sum(g[1:i]), 0) + coalesce(list_sum(m[1:i]), 0))::INT}}) AS found FROM (
        SELECT *, list_transform(regexp_extract_all({text}, '{pattern}'), lambda x: length(x)) AS m,
               list_transform(string_split_regex({text}, '{pattern}'), lambda x: length(x)) AS g FROM {source})"""


def predicted_sql() -> str:
    """CTEs on top of zh that end in pred(id, preds), the sorted spans of the three patterns."""
    patterns = {"PERSON": S.person_pattern(), "ADDRESS": S.address_pattern(_OTHER, ""), "ORG": S.org_pattern(_OTHER, "")}
    each = ", ".join(f"p_{x} AS ({found_sql('zh', p)})" for x, p in patterns.items())
    rows = " UNION ALL ".join(f"SELECT id, unnest(found) AS f, '{x}' AS label FROM p_{x}" for x in patterns)
    return f"""{each}, flat AS (SELECT id, f.s AS s, f.e AS e, label FROM ({rows})),
      pred AS (SELECT zh.id, coalesce(p.preds, []) AS preds FROM zh LEFT JOIN (
        SELECT id, list({{'start': s, 'end': e, 'label': label}} ORDER BY s, e, label) AS preds FROM flat GROUP BY id) p ON zh.id = p.id)"""


def counts_sql() -> str:
    """Recursive CTEs that end in counts(id, tier, rule, label, tp, fp, fn): greedy matching, one gold span a step."""
    return f"""WITH RECURSIVE {corpus_sql()}, {predicted_sql()},
      seed AS (SELECT zh.id, tier, rule, label, list_filter(spans, lambda s: s.label = label) AS gold, list_filter(preds, lambda s: s.label = label) AS rest
        FROM zh JOIN pred ON zh.id = pred.id, (VALUES ('exact'), ('overlap')) r(rule), (VALUES ('PERSON'), ('ADDRESS'), ('ORG')) l(label)),
      walk AS (
        SELECT id, tier, rule, label, gold, rest, 0 AS tp, 0 AS fn FROM seed
        UNION ALL
        SELECT id, tier, rule, label, gold[2:], CASE WHEN pos IS NULL THEN rest ELSE list_concat(rest[1:pos - 1], rest[pos + 1:]) END,
          tp + (pos IS NOT NULL)::INT, fn + (pos IS NULL)::INT FROM (
            SELECT *, list_position(list_transform(rest, lambda p: CASE WHEN rule = 'exact' THEN p.start = gold[1].start AND p."end" = gold[1]."end"
              ELSE gold[1].start < p."end" AND p.start < gold[1]."end" END), true) AS pos FROM walk WHERE len(gold) > 0)),
      counts AS (SELECT id, tier, rule, label, tp, len(rest) AS fp, fn FROM walk WHERE len(gold) = 0)"""


RATES = """round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1"""
SHARES = """CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS r"""


def flat_spans(df: DataFrame, column: str) -> DataFrame:
    return S.each_span(df.select("id", column), column).select("id", "s.start", "s.end", "s.label")


@query(f"WITH {corpus_sql()} SELECT id, text, tier, template_id, len(spans)::INT AS n_spans FROM zh")
def zh_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("id", "text", "tier", "template_id", F.size("entities").alias("n_spans"))


@query(f'WITH {corpus_sql()} SELECT id, s.start AS start, s."end" AS "end", s.label AS label FROM (SELECT id, unnest(spans) AS s FROM zh)')
def gold_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_spans(corpus(spark, sf_dir), "entities")


def pattern_predictions(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("regex").alias("system"), "id", S.pattern_spans(F.col("text")).alias("spans"))


@query(f'WITH {corpus_sql()}, {predicted_sql()} SELECT id, s AS start, e AS "end", label FROM flat')
def regex_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_spans(pattern_predictions(corpus(spark, sf_dir)), "spans")


@query(f"WITH {corpus_sql()}, {predicted_sql()} SELECT label, count(*) AS n, avg(e - s) AS mean_length FROM flat GROUP BY label")
def span_counts_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flat_spans(pattern_predictions(corpus(spark, sf_dir)), "spans")
    return found.groupBy("label").agg(F.count("*").alias("n"), F.avg(F.col("end") - F.col("start")).alias("mean_length"))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted spans of each row: both from one scan, so there is nothing to join."""
    rows = corpus(spark, sf_dir).withColumn("pred", S.pattern_spans(F.col("text")))
    return rows.select(F.lit("regex").alias("system"), "id", "text", "tier", F.col("entities").alias("gold"), "pred")


_TOTALS = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn"


@query(f"""{counts_sql()}, s AS (SELECT rule, coalesce(label, 'micro') AS label, {_TOTALS} FROM counts GROUP BY GROUPING SETS ((rule, label), (rule)))
  SELECT 'regex' AS system, rule, label, tp, fp, fn, {RATES} FROM (SELECT *, {SHARES} FROM s)""")
def score_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_by_label(scoring.row_counts(joined(spark, sf_dir)))


@query(f"""{counts_sql()}, s AS (SELECT rule, tier, {_TOTALS} FROM counts WHERE tier <> 'negative' GROUP BY rule, tier)
  SELECT 'regex' AS system, rule, tier, tp, fp, fn, {RATES} FROM (SELECT *, {SHARES} FROM s)""")
def score_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_by_tier(scoring.row_counts(joined(spark, sf_dir)))


@query(f"""WITH {corpus_sql()}, {predicted_sql()} SELECT 'regex' AS system, count(*) FILTER (tier = 'negative') AS n,
  count(*) FILTER (tier = 'negative' AND len(preds) > 0) AS fired,
  round_even(count(*) FILTER (tier = 'negative' AND len(preds) > 0) / nullif(count(*) FILTER (tier = 'negative'), 0)::DOUBLE, 4) AS fpr FROM zh JOIN pred ON zh.id = pred.id""")
def negatives_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.negatives(joined(spark, sf_dir))


@query(f"""{counts_sql()} SELECT 'regex' AS system, fp, chars, round_even(1000 * fp / chars::DOUBLE, 4) AS false_per_1000 FROM
  (SELECT sum(fp)::BIGINT AS fp FROM counts WHERE rule = 'exact'), (SELECT sum(length(text))::BIGINT AS chars FROM zh)""")
def false_entities_per_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.false_per_1000(joined(spark, sf_dir))


_STORED = ("echo", "other")


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold rows, and predictions of two systems: one lacks every third row, one has labels outside the domain and late starts."""
    rows = corpus(spark, sf_dir)
    late = F.transform("entities", lambda s: S.span_struct(s["start"] + 1, s["end"], s["label"]))
    odd = F.transform("entities", lambda s: S.span_struct(s["start"], s["end"], F.lit("OTHER")))
    answer = lambda system, spans: F.struct(F.lit(system).alias("system"), spans.alias("spans"))
    # both systems' in one pass, so that sentences are made once for them
    each = F.array(F.when(F.col("k") % 3 != 0, answer("echo", F.col("entities"))), answer("other", F.when(F.col("k") % 2 == 0, odd).otherwise(late)))
    found = S.each_span(rows.select("id", each.alias("each")), "each").select("s.system", "id", "s.spans")
    return rows.select("id", "text", "tier", F.col("entities").alias("spans")), found


@query(f"""WITH RECURSIVE {corpus_sql()}, preds AS (
    SELECT 'echo' AS system, id, tier, spans, CASE WHEN k % 3 <> 0 THEN spans ELSE [] END AS preds FROM zh UNION ALL
    SELECT 'other', id, tier, spans, list_transform(spans, lambda s: {{'start': CASE WHEN k % 2 = 0 THEN s.start ELSE s.start + 1 END, 'end': s."end", 'label': CASE WHEN k % 2 = 0 THEN 'OTHER' ELSE s.label END}}) FROM zh),
  seed AS (SELECT system, rule, label, list_filter(spans, lambda s: s.label = label) AS gold, list_filter(preds, lambda s: s.label = label) AS rest
    FROM preds, (VALUES ('exact'), ('overlap')) r(rule), (VALUES ('PERSON'), ('ADDRESS'), ('ORG')) l(label)),
  walk AS (SELECT system, rule, label, gold, rest, 0 AS tp, 0 AS fn FROM seed UNION ALL
    SELECT system, rule, label, gold[2:], CASE WHEN pos IS NULL THEN rest ELSE list_concat(rest[1:pos - 1], rest[pos + 1:]) END, tp + (pos IS NOT NULL)::INT, fn + (pos IS NULL)::INT FROM (
      SELECT *, list_position(list_transform(rest, lambda p: CASE WHEN rule = 'exact' THEN p.start = gold[1].start AND p."end" = gold[1]."end" ELSE gold[1].start < p."end" AND p.start < gold[1]."end" END), true) AS pos FROM walk WHERE len(gold) > 0)),
  s AS (SELECT system, rule, coalesce(label, 'micro') AS label, sum(tp)::BIGINT AS tp, sum(len(rest))::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM walk WHERE len(gold) = 0 GROUP BY GROUPING SETS ((system, rule, label), (system, rule)))
  SELECT system, rule, label, tp, fp, fn, {RATES} FROM (SELECT *, {SHARES} FROM s)""")
def system_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_by_label(scoring.row_counts(scoring.join_predictions(*_stored(spark, sf_dir), dimension(spark, "system", _STORED))))


@query(f"""WITH {corpus_sql()} SELECT system, count(*) FILTER (tier = 'negative') AS n, 0::BIGINT AS fired, 0.0::DOUBLE AS fpr FROM zh, (VALUES ('echo'), ('other')) s(system) GROUP BY system""")
def system_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.negatives(scoring.join_predictions(*_stored(spark, sf_dir)))


@query("""WITH c AS (SELECT event_type AS system, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events)
  SELECT system, coalesce(round_even(quantile_cont(value, 0.5) FILTER (place > 10), 4), 0) AS p50, coalesce(round_even(quantile_cont(value, 0.95) FILTER (place > 10), 4), 0) AS p95,
    coalesce(round_even(avg(value) FILTER (place > 10), 4), 0) AS mean, count(value) FILTER (place > 10) AS n, least(count(*), 10)::BIGINT AS warmup FROM c GROUP BY system""")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("system"), F.col("event_id").alias("ord"), F.col("value").alias("ms"))
    return scoring.latency_summary(calls).withColumn("warmup", F.col("warmup").cast("long"))


@query("""WITH r AS (SELECT event_type AS model, (user_id % 2)::VARCHAR AS condition, user_id, min(value) AS cold, max(value) AS first,
    list(value) AS ls, CASE WHEN user_id % 7 = 0 THEN 'failed' END AS error, user_id % 11 = 0 AS timed_out FROM events GROUP BY event_type, user_id
  ), o AS (SELECT * FROM r WHERE error IS NULL AND NOT timed_out
  ), p AS (SELECT model, condition, quantile_cont(v, 0.5) AS latency_p50, quantile_cont(v, 0.95) AS latency_p95, count(*) AS latency_n FROM (SELECT model, condition, unnest(ls) AS v FROM o) GROUP BY ALL
  ), s AS (SELECT model, condition, count(*) FILTER (error IS NULL AND NOT timed_out) AS ok_run_count,
    median(cold) FILTER (error IS NULL AND NOT timed_out) AS cold_load_ms_median, min(cold) FILTER (error IS NULL AND NOT timed_out) AS cold_load_ms_min,
    max(cold) FILTER (error IS NULL AND NOT timed_out) AS cold_load_ms_max, median(first) FILTER (error IS NULL AND NOT timed_out) AS first_inference_ms_median,
    min(first) FILTER (error IS NULL AND NOT timed_out) AS first_inference_ms_min, max(first) FILTER (error IS NULL AND NOT timed_out) AS first_inference_ms_max FROM r GROUP BY ALL)
  SELECT s.* REPLACE (round_even(cold_load_ms_median, 6) AS cold_load_ms_median, round_even(first_inference_ms_median, 6) AS first_inference_ms_median),
    round_even(latency_p50, 6) AS latency_p50, round_even(latency_p95, 6) AS latency_p95, latency_n FROM s LEFT JOIN p USING (model, condition)""")
def run_summary_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), "user_id").agg(F.min("value").alias("cold_load_ms"), F.max("value").alias("first_inference_ms"), F.collect_list("value").alias("latencies_ms"))
    runs = runs.withColumns({"condition": (F.col("user_id") % 2).cast("string"), "error": F.when(F.col("user_id") % 7 == 0, "failed"), "timed_out": F.col("user_id") % 11 == 0})
    found = scoring.run_summary(runs)
    return found.withColumns({c: X.half_even(F.col(c), 6) for c in ("cold_load_ms_median", "first_inference_ms_median", "latency_p50", "latency_p95")})


# A model's answer for a row: its spans' texts, the last first, each twice for every third row, and one that isn't there.
_ANSWER = """concat('{"spans":[', array_to_string(list_transform(list_reverse(spans), lambda s: concat('{"text":"', substr(text, s.start + 1, s."end" - s.start), '","label":"', s.label, '"}',
  CASE WHEN k % 3 = 0 THEN concat(',{"text":"', substr(text, s.start + 1, s."end" - s.start), '","label":"', s.label, '"}') ELSE '' END)), ','),
  CASE WHEN len(spans) > 0 THEN ',' ELSE '' END, '{"text":"☃","label":"ORG"},{"text":"","label":"ORG"},{"text":"x","label":"OTHER"}', CASE WHEN k % 5 = 0 THEN '' ELSE ']}' END)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    one = lambda s: F.concat(F.lit('{"text":"'), S.surface_of(F.col("text"), s), F.lit('","label":"'), s["label"], F.lit('"}'))
    items = F.array_join(F.transform(F.reverse("entities"), lambda s: F.concat(one(s), F.when(F.col("k") % 3 == 0, F.concat(F.lit(","), one(s))).otherwise(""))), ",")
    comma = F.when(F.size("entities") > 0, ",").otherwise("")
    tail = F.lit('{"text":"☃","label":"ORG"},{"text":"","label":"ORG"},{"text":"x","label":"OTHER"}')
    return rows.select("id", "text", F.concat(F.lit('{"spans":['), items, comma, tail, F.when(F.col("k") % 5 == 0, "").otherwise("]}")).alias("response"))


@query(f"""WITH {corpus_sql()}, a AS (SELECT id, {_ANSWER} AS response FROM zh),
  i AS (SELECT id, NOT json_valid(response) AS failed, CASE WHEN json_valid(response) THEN json_extract(response, '$.spans[*]') ELSE [] END AS items FROM a)
  SELECT id, failed, len(list_filter(items, lambda x: json_extract_string(x, '$.label') IN ('PERSON', 'ADDRESS', 'ORG')))::INT AS n_items,
    array_to_string(list_transform(list_filter(items, lambda x: json_extract_string(x, '$.label') IN ('PERSON', 'ADDRESS', 'ORG')), lambda x: concat(json_extract_string(x, '$.label'), '=', json_extract_string(x, '$.text'))), ';') AS items FROM i""")
def parse_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = answers(spark, sf_dir).select("id", responses.parse_items(F.col("response")).alias("p"))
    shown = F.array_join(F.transform("p.items", lambda x: F.concat_ws("=", x["label"], x["text"])), ";")
    return parsed.select("id", F.col("p.failed").alias("failed"), F.size("p.items").alias("n_items"), shown.alias("items"))


@query(f"""WITH RECURSIVE {corpus_sql()}, a AS (SELECT id, text, {_ANSWER} AS response FROM zh),
  i AS (SELECT id, text, NOT json_valid(response) AS failed, list_filter(list_transform(CASE WHEN json_valid(response) THEN json_extract(response, '$.spans[*]') ELSE [] END,
    lambda x: {{'t': json_extract_string(x, '$.text'), 'l': json_extract_string(x, '$.label')}}), lambda x: x.l IN ('PERSON', 'ADDRESS', 'ORG')) AS items FROM a),
  w AS (SELECT id, text, failed, items, 0 AS cur, [] :: STRUCT(s INT, e INT, l VARCHAR)[] AS found, 0 AS unlocated, 0 AS relocated, 0 AS ignored FROM i
    UNION ALL
    SELECT id, text, failed, items[2:], CASE WHEN ok AND pos > 0 THEN (pos - 1 + n)::INT ELSE cur END,
      CASE WHEN ok AND pos > 0 THEN list_append(found, {{'s': (pos - 1)::INT, 'e': (pos - 1 + n)::INT, 'l': items[1].l}}) ELSE found END,
      unlocated + (ok AND pos = 0)::INT, relocated + (ok AND pos > 0 AND ahead = 0)::INT, ignored + (NOT ok)::INT FROM (
        SELECT *, CASE WHEN ahead > 0 THEN ahead ELSE strpos(text, items[1].t) END AS pos FROM (
          SELECT *, length(items[1].t) AS n, length(items[1].t) BETWEEN 1 AND 100 AS ok,
            CASE WHEN strpos(substr(text, cur + 1), items[1].t) > 0 THEN strpos(substr(text, cur + 1), items[1].t) + cur ELSE 0 END AS ahead FROM w WHERE len(items) > 0)))
  SELECT id, failed, len(list_distinct(found))::INT AS n_spans, unlocated, relocated, ignored, coalesce(list_sum(list_transform(list_distinct(found), lambda f: f.s * 1000 + f.e)), 0)::BIGINT AS places FROM w WHERE len(items) = 0""")
def locate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = responses.located_responses(answers(spark, sf_dir))
    places = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["start"] * 1000 + s["end"]).cast("long"))
    return found.select("id", "failed", F.size("spans").alias("n_spans"), "unlocated", "relocated", "ignored", places.alias("places"))


_SHOTS = [("客戶王小明來電。", '{"spans":[{"text":"王小明","label":"PERSON"}]}'), ("本月無異動。", '{"spans":[]}')]
_SHOT_BYTES = sum(len(x.encode()) for pair in _SHOTS for x in pair)


@query(f"SELECT conv_id, sum({_SHOT_BYTES} + 6 + octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes_sent, count(*) AS calls, max(5) AS n_messages FROM conversations GROUP BY conv_id")
def few_shot_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("messages", responses.few_shot_messages(F.coalesce("text", F.lit("")), _SHOTS))
    return rows.groupBy("conv_id").agg(F.sum(responses.bytes_sent(F.col("messages"), "detect")).cast("long").alias("bytes_sent"), F.count("*").alias("calls"), F.max(F.size("messages")).alias("n_messages"))


@query(f"""WITH {corpus_sql()} SELECT id, concat(array_to_string(list_transform(range(1, len(spans) + 1), lambda i: concat(
    substr(text, CASE WHEN i = 1 THEN 1 ELSE spans[i - 1]."end" + 1 END, CASE WHEN i = 1 THEN spans[1].start ELSE spans[i].start - spans[i - 1]."end" END),
    '⟦', substr(text, spans[i].start + 1, spans[i]."end" - spans[i].start), '⟧')), ''),
    substr(text, CASE WHEN len(spans) = 0 THEN 1 ELSE spans[-1]."end" + 1 END)) AS marked FROM zh""")
def mark_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("id", S.mark_spans(F.col("text"), F.col("entities")).alias("marked"))


_FORM = """CASE WHEN label = 'PERSON' AND NOT regexp_matches(surface, '(先生|小姐|女士)$') THEN concat('PERSON: ', length(surface), '-character name')
  WHEN label = 'PERSON' AND length(surface) = 3 THEN 'PERSON: surname + honorific' WHEN label = 'PERSON' THEN 'PERSON: full name + honorific'
  WHEN label = 'ADDRESS' AND NOT ends_with(surface, '號') THEN 'ADDRESS: city and district only'
  WHEN label = 'ADDRESS' AND regexp_matches(surface, '[０-９]') THEN 'ADDRESS: street, fullwidth digits' WHEN label = 'ADDRESS' THEN 'ADDRESS: street, ASCII digits' ELSE label END"""
_FORMS = f"""forms AS (SELECT id, label, {_FORM} AS form FROM (SELECT id, s.label AS label, substr(text, s.start + 1, s."end" - s.start) AS surface FROM (SELECT id, text, unnest(spans) AS s FROM zh)))"""
_CELLS = f"""{_FORMS}, cells AS (SELECT id, concat('tier: ', tier) AS cell FROM zh UNION SELECT id, concat('template: ', template_id) FROM zh UNION SELECT id, form FROM forms
  UNION SELECT id, 'text: punctuation removed' FROM zh WHERE len(spans) > 0 AND NOT contains(text, '。'))"""


@query(f"WITH {corpus_sql()}, {_FORMS} SELECT form, count(*) AS n FROM forms GROUP BY form")
def span_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.each_span(corpus(spark, sf_dir).select("text", "entities"), "entities")
    return rows.select(S.span_form(F.col("s.label"), S.surface_of(F.col("text"), F.col("s"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


def celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).withColumn("cells", S.coverage_cells(F.col("text"), F.col("entities"), F.col("tier"), F.col("template_id")))


@query(f"WITH {corpus_sql()}, {_CELLS} SELECT id, count(*)::INT AS n_cells FROM cells GROUP BY id")
def coverage_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return celled(spark, sf_dir).select("id", F.size("cells").alias("n_cells"))


@query(f"""WITH {corpus_sql()}, {_CELLS} SELECT cell, count(*) AS n, count(*) FILTER (k % 10 = 0) AS in_sample FROM cells JOIN zh USING (id) GROUP BY cell""")
def cell_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.cell_population(celled(spark, sf_dir), F.col("k") % 10 == 0)


@query(f"""WITH {corpus_sql()} SELECT id, CASE WHEN k % 6 = 0 THEN 'markup' WHEN k % 6 = 1 AND len(spans) > 0 THEN 'span' END AS problem FROM zh""")
def display_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    text = F.when(F.col("k") % 6 == 0, F.concat("text", F.lit("`"))).otherwise(F.col("text"))
    broken = F.transform("entities", lambda s: S.span_struct(s["end"], s["start"], s["label"]))
    spans = F.when(F.col("k") % 6 == 1, broken).otherwise(F.col("entities"))
    return rows.select("id", S.display_problem(text, spans).alias("problem"))


def unknowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of other than ASCII characters in documents, as unknown tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("source"))
    return docs.withColumn("unk_char_spans", S.find_matches(F.col("text"), r"[^\x00-\x7f]+"))


@query(r"""SELECT lang AS source, sum(length(array_to_string(regexp_extract_all(coalesce(text, ''), '[^\x00-\x7f]+'), '')))::BIGINT AS unk_chars, sum(length(coalesce(text, '')))::BIGINT AS chars,
  round_even(sum(length(array_to_string(regexp_extract_all(coalesce(text, ''), '[^\x00-\x7f]+'), ''))) / nullif(sum(length(coalesce(text, ''))), 0)::DOUBLE, 6) AS rate FROM documents GROUP BY lang""")
def unk_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.unknown_rate(unknowns(spark, sf_dir))


@query(r"""WITH u AS (SELECT doc_id, unnest(m) AS text, unnest(range(len(m))) AS place FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x7f]+') AS m FROM documents))
  SELECT text, count(*) AS n FROM u GROUP BY text ORDER BY n DESC, min({'d': doc_id, 'p': place}) LIMIT 30""")
def top_unk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.top_unknown(unknowns(spark, sf_dir), 30, "doc_id")


@query(r"""WITH d AS (SELECT lang AS source, length(coalesce(text, '')) AS c, len(regexp_extract_all(coalesce(text, ''), '[^ \n]+')) AS n FROM documents)
  SELECT source, count(*) AS n, round_even(avg(n), 4) AS mean_tokens, round_even(quantile_cont(n, 0.95), 4) AS p95_tokens, max(n)::BIGINT AS max_tokens,
    round_even(avg(n / greatest(c, 1)::DOUBLE), 4) AS tokens_per_char, count(*) FILTER (n > 512) AS over_cap FROM d GROUP BY source""")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^ \n]+"), F.lit(0)))
    return T.token_stats(table(spark, sf_dir, "documents").select(F.col("lang").alias("source"), text.alias("text"), words.alias("num_ids")))


@query(r"""SELECT lang AS source, doc_id AS id, len(regexp_extract_all(coalesce(text, ''), '[^ \n]+'))::INT AS num_ids FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '[^ \n]+')) > 512""")
def over_cap_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \n]+"), F.lit(0)))
    dump = table(spark, sf_dir, "documents").select(F.col("lang").alias("source"), F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), words.alias("num_ids"))
    return T.over_cap(dump, 512).select("source", "id", "num_ids")


def _encodings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Word lengths of each document, and those of the second engine, which lacks some rows and merges dashes in others."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("source"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("ord"))
    ids = lambda t: F.transform(F.split(t, " "), F.length)
    return docs.withColumn("input_ids", ids(F.col("text"))), docs.where("id % 9 != 0").withColumn("input_ids", ids(F.replace(F.col("text"), F.lit(". "), F.lit("."))))


_PARITY = """WITH a AS (SELECT doc_id AS id, lang AS source, coalesce(text, '') AS text FROM documents), b AS (
    SELECT id, source, id % 9 <> 0 AND list_transform(string_split(text, ' '), lambda x: length(x)) = list_transform(string_split(replace(text, '. ', '.'), ' '), lambda x: length(x)) AS same FROM a)"""


@query(f"""{_PARITY} SELECT coalesce(source, 'all') AS source, count(*) AS total, count(*) FILTER (same) AS matches, count(*) FILTER (NOT same) AS mismatches,
  round_even(count(*) FILTER (same) / count(*)::DOUBLE, 6) AS match_rate FROM b GROUP BY GROUPING SETS ((source), ())""")
def parity_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.parity(*_encodings(spark, sf_dir))


@query(f"""{_PARITY} SELECT source, place::INT AS place, id FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) AS place FROM b WHERE NOT same) WHERE place <= 20""")
def parity_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.first_mismatches(*_encodings(spark, sf_dir), 20)


@query(f"""WITH {corpus_sql()}, s AS (SELECT id, text, unnest(spans) AS s FROM zh)
  SELECT id, s.start AS start, s."end" AS "end", (s.start // 3 * 3)::INT AS first, least((s."end" - 1) // 3 * 3 + 3, length(text))::INT AS last FROM s""")
def entity_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(3))
    windows = F.transform(starts, lambda a: F.struct(a.alias("start"), F.least(a + 3, F.length("text")).alias("end")))
    rows = corpus(spark, sf_dir).where(F.length("text") > 0).withColumn("windows", windows)
    rows = S.each_span(rows.select("id", "windows", "entities"), "entities")
    covered = rows.withColumn("c", K.covering_tokens(F.col("windows"), F.col("s.start"), F.col("s.end")))
    return covered.select("id", "s.start", "s.end", F.col("c.start").alias("first"), F.col("c.end").alias("last"))


@lru_cache(1 << 12)
def _borders(size: int) -> list[tuple[int, int]]:
    n, at = 4 * (size // 10) + sum(size % 10 > x for x in (0, 1, 4, 6)), (0, 1, 4, 6)
    return [(10 * (i // 4) + at[i % 4], min(10 * ((i + 1) // 4) + at[(i + 1) % 4], size)) for i in range(n)]


@lru_cache(1 << 12)
def _odd(n: int, third: bool, even: bool) -> list[tuple[int, str | None]]:
    """Places of tokens that are something else than their text, None for a marked one."""
    kind = lambda i: "[UNK]" if i % 7 == 3 or (i % 7 == 4 and third) else "☃" if i % 23 == 19 and even else "▁" if i % 13 == 12 else None if i % 5 == 1 else ""
    return [(i, kind(i)) for i in range(n) if kind(i) != ""]


def _cut(k: int, text: str) -> tuple[list[str], list[tuple[int, int]]]:
    truth = _borders(len(text))
    tokens = [text[start:end] for start, end in truth]
    for i, other in _odd(len(truth), k % 3 == 0, k % 2 == 0):
        tokens[i] = "##" + tokens[i] if other is None else other
    return tokens[:-1] if k % 17 == 0 else tokens, truth


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences cut into tokens of 1, 3, 2 and 4 characters in turn: some unknown, also side by side, some marked, some of no
    text or of one that isn't there, and every seventeenth row without its last token."""

    def run(batches):
        for b in batches:
            tokens, truth = zip(*map(_cut, values_of(b.column("k")), values_of(b.column("text"))), strict=True) if b.num_rows else ([], [])
            yield b.append_column("tokens", list_array(list(tokens), lambda flat: pa.array(flat, pa.string()))).append_column("truth", offset_lists(list(truth)))

    return corpus(spark, sf_dir).where(F.length("text") > 0).mapInArrow(run, f"{KEYED}, tokens array<string>, truth {K.OFFSETS}")


_WALK = f"""WITH RECURSIVE {corpus_sql()},
  cut AS (SELECT *, length(text) AS size, 4 * (length(text) // 10) + CASE WHEN length(text) % 10 > 6 THEN 4 WHEN length(text) % 10 > 4 THEN 3 WHEN length(text) % 10 > 1 THEN 2 WHEN length(text) % 10 > 0 THEN 1 ELSE 0 END AS n FROM zh WHERE length(text) > 0),
  borders AS (SELECT *, list_transform(range(n + 1), lambda i: 10 * (i // 4) + [0, 1, 4, 6][i % 4 + 1]) AS cuts FROM cut),
  truths AS (SELECT *, list_transform(range(n), lambda i: {{'start': cuts[i + 1]::INT, 'end': least(cuts[i + 2], size)::INT}}) AS truth, list_transform(range(n), lambda i: CASE WHEN i % 7 = 3 OR (i % 7 = 4 AND k % 3 = 0) THEN '[UNK]'
    WHEN i % 23 = 19 AND k % 2 = 0 THEN '☃' WHEN i % 13 = 12 THEN '▁' WHEN i % 5 = 1 THEN '##' || substr(text, cuts[i + 1] + 1, cuts[i + 2] - cuts[i + 1]) ELSE substr(text, cuts[i + 1] + 1, cuts[i + 2] - cuts[i + 1]) END) AS tokens FROM borders),
  walk AS (
    SELECT id, k, tier, text, size, spans, truth, CASE WHEN k % 17 = 0 THEN tokens[:-2] ELSE tokens END AS tokens, 0 AS i, 0 AS cur, [] :: STRUCT("start" INT, "end" INT)[] AS rebuilt FROM truths
    UNION ALL
    SELECT id, k, tier, text, size, spans, truth, tokens, i + 1, CASE WHEN missing THEN size ELSE found_end END, list_append(rebuilt, CASE WHEN NOT missing THEN {{'start': found_start, 'end': found_end}} END) FROM (
      SELECT *, NOT unknown AND piece <> '' AND ahead = 0 AS missing, (CASE WHEN unknown OR piece = '' THEN cur ELSE cur + ahead - 1 END)::INT AS found_start,
        (CASE WHEN unknown THEN CASE WHEN bound_ahead > 1 THEN cur + bound_ahead - 1 ELSE least(cur + 1, size) END WHEN piece = '' THEN cur ELSE cur + ahead - 1 + length(piece) END)::INT AS found_end FROM (
        SELECT *, CASE WHEN piece = '' THEN 0 ELSE strpos(substr(text, cur + 1), piece) END AS ahead, CASE WHEN bound IS NULL THEN 0 ELSE strpos(substr(text, cur + 1), bound) END AS bound_ahead FROM (
          SELECT *, tokens[i + 1] = '[UNK]' AS unknown, regexp_replace(tokens[i + 1], '^(##|▁)', '') AS piece,
            CASE WHEN i + 1 >= len(tokens) OR tokens[i + 2] = '[UNK]' THEN NULL WHEN regexp_replace(tokens[i + 2], '^(##|▁)', '') <> '' THEN regexp_replace(tokens[i + 2], '^(##|▁)', '')
              WHEN i + 2 >= len(tokens) OR tokens[i + 3] = '[UNK]' THEN NULL WHEN regexp_replace(tokens[i + 3], '^(##|▁)', '') <> '' THEN regexp_replace(tokens[i + 3], '^(##|▁)', '') END AS bound
          FROM walk WHERE i < len(tokens))))),
  done AS (SELECT *, len(rebuilt) = len(truth) AS even FROM walk WHERE i = len(tokens))"""


@query(f"""{_WALK}, per_token AS (SELECT tier, count(*) AS rows, count(*) FILTER (NOT even) AS uneven, sum(len(truth)) FILTER (even)::BIGINT AS tokens,
    sum(len(list_filter(range(1, len(truth) + 1), lambda j: rebuilt[j] IS NOT DISTINCT FROM truth[j]))) FILTER (even)::BIGINT AS tokens_right FROM done GROUP BY tier),
  each_span AS (SELECT tier, truth, rebuilt, s, list_filter(range(1, len(truth) + 1), lambda j: truth[j].start < s."end" AND truth[j]."end" > s.start) AS hits FROM (SELECT tier, truth, rebuilt, unnest(spans) AS s FROM done WHERE even)),
  per_entity AS (SELECT tier, count(*) FILTER (len(hits) > 0) AS entities, count(*) FILTER (len(hits) > 0 AND rebuilt[hits[1]].start = s.start AND rebuilt[hits[-1]]."end" = s."end") AS entities_right FROM each_span GROUP BY tier)
  SELECT tier AS tokenizer, rows, uneven, tokens, tokens_right, coalesce(entities, 0) AS entities, coalesce(entities_right, 0) AS entities_right, round_even(tokens_right / tokens::DOUBLE, 6) AS token_accuracy,
    CASE WHEN entities > 0 THEN round_even(entities_right / entities::DOUBLE, 6) END AS entity_accuracy FROM per_token LEFT JOIN per_entity USING (tier)""")
def rebuilt_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.rebuilt_accuracy(T.with_rebuilt(_pieces(spark, sf_dir)).withColumn("tokenizer", F.col("tier")))


@query(f"""{_WALK}, wrong AS (SELECT tier, k, id, j - 1 AS token, rebuilt[j] AS r, truth[j] AS t FROM (SELECT *, unnest(range(1, len(truth) + 1)) AS j FROM done WHERE even))
  SELECT tier AS tokenizer, place, id, token::INT AS token, r.start AS rebuilt_start, t.start AS true_start FROM (
    SELECT *, row_number() OVER (PARTITION BY tier ORDER BY k, token)::INT AS place FROM wrong WHERE r IS DISTINCT FROM t) WHERE place <= 20""")
def rebuilt_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.rebuilt_mismatches(T.with_rebuilt(_pieces(spark, sf_dir)).withColumns({"tokenizer": F.col("tier"), "ord": F.col("k")}))
    return found.select("tokenizer", "place", "id", "token", F.col("rebuilt.start").alias("rebuilt_start"), F.col("truth.start").alias("true_start"))


def _characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each character a token, every seventh of them unknown and every fifth special."""

    @F.arrow_udf("tokens array<string>, offsets array<array<int>>, mask array<int>")
    def run(texts: pa.Array) -> pa.Array:
        own = values_of(texts)
        cuts = np.cumsum([0, *map(len, own)], dtype=np.int32)
        place = np.arange(cuts[-1], dtype=np.int32) - np.repeat(cuts[:-1], np.diff(cuts))
        chars = pc.if_else(pa.array(place % 7 == 6), "[UNK]", pa.array(list("".join(own)), pa.string()))
        pairs = pa.ListArray.from_arrays(pa.array(2 * np.arange(len(place) + 1, dtype=np.int32)), pa.array(np.stack([place, place + 1], 1).ravel()))
        lists = [pa.ListArray.from_arrays(pa.array(cuts), x) for x in (chars, pairs, pa.array((place % 5 == 4).astype(np.int32)))]
        return pa.StructArray.from_arrays(lists, names=["tokens", "offsets", "mask"])

    rows = corpus(spark, sf_dir).where(F.length("text") > 0).select("id", "text", run("text").alias("c"))
    return rows.select("id", "text", "c.tokens", "c.offsets", "c.mask")


@query(f"""WITH {corpus_sql()}, p AS (SELECT id, unnest(range(1, length(text) + 1)) AS i, text FROM zh)
  SELECT id, count(*) FILTER (i % 7 = 0)::INT AS n_unknown, count(*) FILTER (i % 5 <> 0)::INT AS n_content FROM p GROUP BY id""")
def token_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _characters(spark, sf_dir)
    unknown = K.unknown_spans(F.col("text"), F.col("tokens"), F.col("offsets"), "[UNK]")
    return rows.select("id", F.size(unknown).alias("n_unknown"), F.size(K.content_tokens(F.col("tokens"), F.col("mask"))).alias("n_content"))


@query(f"""WITH q AS (SELECT lang, coalesce(regexp_matches(text, 'stupid|trash|scum'), false) AS pred, toxic = 1 AS gold FROM labels JOIN documents USING (doc_id)),
  s AS (SELECT lang, count(*) FILTER (gold AND pred) AS tp, count(*) FILTER (pred AND NOT gold) AS fp, count(*) FILTER (gold AND NOT pred) AS fn FROM q GROUP BY lang)
  SELECT lang, tp, fp, fn, {RATES} FROM (SELECT *, {SHARES} FROM s)""")
def rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    pred, gold = F.coalesce(F.col("text").rlike("stupid|trash|scum"), F.lit(False)), F.col("toxic") == 1
    return scoring.with_rates(rows.groupBy("lang").agg(F.count_if(gold & pred).alias("tp"), F.count_if(pred & ~gold).alias("fp"), F.count_if(gold & ~pred).alias("fn")))


@query("SELECT c_custkey, c_name AS name FROM customer WHERE c_name NOT IN (SELECT replace(s_name, 'Supplier', 'Customer') FROM supplier WHERE s_name IS NOT NULL)")
def blocklist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    blocked = table(spark, sf_dir, "supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"))
    return relational.without_blocked(names, blocked)


@query("""SELECT source, count(*) AS n, count(segment) AS with_segment FROM (SELECT 'customer' AS source, c_name AS name, c_mktsegment AS segment FROM customer
  UNION ALL SELECT 'supplier', s_name, NULL FROM supplier) GROUP BY source""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"customer": table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), "supplier": table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))}
    return relational.tagged_union(parts).groupBy("source").agg(F.count("*").alias("n"), F.count("segment").alias("with_segment"))


@query("""SELECT coalesce(s_suppkey, c_custkey) AS key, CASE WHEN s_suppkey IS NOT NULL THEN s_acctbal ELSE c_acctbal END AS balance FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""")
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return relational.upsert(old, new, "key", ["balance"])


@query("SELECT event_id, value FROM events")
def append_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select("event_id", "value")
    return relational.append_runs(relational.append_runs(runs.where("event_id % 3 = 0"), runs, "event_id"), runs, "event_id")


@query(f"""WITH {corpus_sql()}, {predicted_sql()}, r AS (SELECT id, s, e, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM flat)
  SELECT id, s AS start, e AS "end" FROM r WHERE s < reach""")
def overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pattern_predictions(corpus(spark, sf_dir)).withColumn("late", S.overlapping(F.col("spans")))
    return flat_spans(found, "late").select("id", "start", "end")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations""")
def forward_fill_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return relational.sections(rows, F.when(F.col("role") == "user", F.col("turn")), "conv_id", "turn").select("conv_id", "turn", "section")


@query("""SELECT coalesce(a.k, b.k) AS number, a.v AS "left", b.v AS "right" FROM (SELECT p_partkey AS k, p_name AS v FROM part WHERE p_partkey % 5 <> 0) a
  FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_name END AS v FROM part WHERE p_partkey % 7 <> 0) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def positional_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("number", F.col("p_partkey"))
    left = part.where("number % 5 != 0").select("number", F.col("p_name").alias("text"))
    right = part.where("number % 7 != 0").select("number", F.when(F.col("number") % 4 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("text"))
    return relational.positional_differences(left, right)


_NARROW = "".join(c for c in X.ASCII if c != "'").replace("'", "''")


@query(f"""SELECT p_partkey, translate(p_type, '{_NARROW}', '{_NARROW.translate(str.maketrans(X.ASCII, X.FULLWIDTH))}') AS wide, translate(p_type, '{lexicon.STRIPPED}', '') AS bare,
  octet_length(encode(translate(p_type, '{_NARROW}', '{_NARROW.translate(str.maketrans(X.ASCII, X.FULLWIDTH))}')))::INT AS wide_bytes FROM part""")
def text_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = X.to_fullwidth(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", wide.alias("wide"), X.strip_punctuation(F.col("p_type")).alias("bare"), X.utf8_bytes(wide).alias("wide_bytes"))


@query(r"""SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM documents""")
def collapsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.collapse_space(F.coalesce("text", F.lit(""))).alias("text"))


@query("""WITH d AS (SELECT o_orderkey, concat('20', lpad((o_orderkey % 30)::VARCHAR, 2, '0'), '-', lpad((o_orderkey % 14)::VARCHAR, 2, '0'), '-', (o_orderkey % 40)::VARCHAR) AS written FROM orders)
  SELECT o_orderkey, written, regexp_matches(written, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND try_cast(written AS DATE) IS NOT NULL AS real FROM d""")
def calendar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    written = F.concat(F.lit("20"), F.lpad((k % 30).cast("string"), 2, "0"), F.lit("-"), F.lpad((k % 14).cast("string"), 2, "0"), F.lit("-"), (k % 40).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"), X.is_calendar_date(written).alias("real"))


@query("""WITH t AS (SELECT l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN '##' WHEN 1 THEN '▁' ELSE '' END || '##' || l_returnflag AS token FROM lineitem)
  SELECT regexp_replace(token, '^(##|▁)', '') AS piece, count(*) AS n FROM t GROUP BY piece""")
def token_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.element_at(F.array(F.lit("##"), F.lit("▁"), F.lit("")), F.col("l_linenumber") % 3 + 1)
    rows = table(spark, sf_dir, "lineitem").select(X.strip_marker(F.concat(marks, F.lit("##"), F.col("l_returnflag"))).alias("piece"))
    return rows.groupBy("piece").agg(F.count("*").alias("n"))


@query(f"""WITH {corpus_sql()}, s AS (SELECT id, unnest(spans) AS s FROM zh)
  SELECT label, count(*) AS n FROM (SELECT CASE s.label WHEN 'PERSON' THEN 'ORG' WHEN 'ADDRESS' THEN 'ADDRESS' END AS label FROM s) WHERE label IS NOT NULL GROUP BY label""")
def mapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).select("id", S.map_labels(F.col("entities"), {"PERSON": "ORG", "ADDRESS": "ADDRESS"}).alias("spans"))
    return flat_spans(rows, "spans").groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {corpus_sql()}, s AS (SELECT id, text, unnest(spans) AS s FROM zh), h AS (SELECT id, s.start AS s, s."end" AS e, s.label AS label, strpos(text, substr(text, s.start + 1, s."end" - s.start)) - 1 AS pos FROM s)
  SELECT label, count(*) AS n, sum(e - s)::BIGINT AS chars FROM h GROUP BY label""")
def hit_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.col("k") % 2 == 0
    hits = F.transform("entities", lambda s: F.struct(S.surface_of(F.col("text"), s).alias("text"), F.when(given, s["start"]).alias("start"), F.when(given, s["end"]).alias("end"), s["label"].alias("label")))
    rows = corpus(spark, sf_dir).select("id", S.hits_to_spans(F.col("text"), hits).alias("spans"))
    return flat_spans(rows, "spans").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"))


_REGIONS = ("ASIA", "EUROPE", "AMERICA", "AFRICA")


@query("""SELECT n_name AS name, r_name AS key, CASE r_name WHEN 'ASIA' THEN 0 WHEN 'EUROPE' THEN 1 WHEN 'AMERICA' THEN 2 ELSE 3 END AS rank
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE', 'AMERICA', 'AFRICA')""")
def ranked_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return relational.named_and_ranked(rows.select(F.col("n_name").alias("name"), F.col("r_name").alias("key")), dimension(spark, "key", _REGIONS))


@query("SELECT coalesce((SELECT p_brand FROM part WHERE p_size > 40 ORDER BY p_partkey LIMIT 1), 'unknown') AS brand")
def first_known_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_size") > 40, F.col("p_brand")).alias("brand"), F.col("p_partkey").alias("rank"))
    return relational.first_known(rows, "brand")


@query("SELECT s_suppkey, round(100 * (1 - pow(0.05::DOUBLE, 1.0::DOUBLE / s_suppkey)), 1) AS bound FROM supplier WHERE s_suppkey > 0")
def audit_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_suppkey > 0").select("s_suppkey", X.upper_bound_percent(F.col("s_suppkey")).alias("bound"))


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form a customer, filled in after the key's remainders, with its blank."""
    k, sha = F.col("c_custkey"), "a" * 64
    either = lambda c, a, b: F.when(c, F.lit(a)).otherwise(F.lit(b))
    mark = F.when(k % 7 == 0, " ").otherwise(F.get(F.array(*map(F.lit, ("x", " ", "X", "v", "Ｘ"))), (k % 5).cast("int")))
    filled = [
        F.concat(F.lit("# Label audit\n\n- Test set SHA-256: `"), either(k % 12 == 7, "b" * 64, sha), F.lit("`\n\n---\n\n## Row 1 of 1: c_"), k.cast("string"), F.lit("\n\n`")),
        F.concat(either(k % 11 == 4, "texts", "text"), F.lit("`\n\n### Span 1 of 1: ORG, start=0, end=4\n\n")),
        F.when(k % 2 == 1, F.concat(F.lit("* [ "), mark, F.lit("]  agree"))).otherwise(F.concat(F.lit("- ["), mark, F.lit("] agree"))),
        F.concat(F.lit("\n- ["), either(k % 7 == 0, "x", " "), F.lit("] disagree\n\nNote:"), either(k % 3 == 0, " wrong", ""), F.lit("\n\n### Unlabeled entities\n\n- [")),
        F.concat(either((k % 4).isin(1, 3), "x", " "), F.lit("] no\n- ["), either(k % 4 == 2, "x", " "), F.lit("] yes\n\nNote:\n"), either(k % 5 == 2, "seen\n", ""), F.lit("\n---\n\n## Verdict\n\n- [")),
        F.concat(either((k % 6).isin(1, 3, 4, 5), "x", " "), F.lit("] PASS\n- ["), either((k % 6).isin(2, 3), "X", " "), F.lit("] FAIL\n\nReviewer:"), either(k % 10 == 3, "", " R")),
        F.concat(F.lit(f"\n\n{audit.DATE}: "), either(k % 8 == 2, "2024-02-30", "2024-05-01"), F.lit("\n\nSummary:\n"), either(k % 9 == 5, "", "fine\n"), F.lit("\n---\n\n## Cells\n\n| Cell | n |\n"), either(k % 2 == 0, "|---|---|", "| :--- | -: |")),
    ]
    text = F.concat(*filled)
    text = F.when(k % 13 == 0, F.replace(text, F.lit("\n"), F.lit(" \r\n"))).when(k % 13 == 1, F.concat(F.lit("\ufeff"), text)).otherwise(text)
    fixed = f"# Label audit\n\n- Test set SHA-256: `{sha}`\n\n---\n\n## Row 1 of 1: c_%d\n\n`text`\n\n### Span 1 of 1: ORG, start=0, end=4\n\n- [ ] agree\n- [ ] disagree\n\nNote:\n\n### Unlabeled entities\n\n- [ ] no\n- [ ] yes\n\nNote:\n\n---\n\n"
    fixed += f"## Verdict\n\n- [ ] PASS\n- [ ] FAIL\n\nReviewer:\n\n{audit.DATE}:\n\nSummary:\n\n---\n\n## Cells\n\n| Cell | n |\n|---|---|"
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select(k.alias("form"), F.when(k % 19 != 18, text).alias("text"), F.format_string(fixed, k).alias("blank"), F.lit(sha).alias("sha256"))


@query("""WITH d AS (SELECT c_custkey AS k, c_custkey % 19 <> 18 AS there, CASE WHEN c_custkey % 7 = 0 THEN (c_custkey % 3 <> 0)::INT ELSE (c_custkey % 5 IN (1, 3))::INT END AS g1,
    CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 2 THEN (c_custkey % 5 <> 2)::INT ELSE 0 END AS g2, (c_custkey % 7 <> 0 AND c_custkey % 5 = 3)::INT AS unreadable, (c_custkey % 12 = 7 OR c_custkey % 11 = 4)::INT AS changed,
    CASE WHEN c_custkey % 6 = 3 THEN 1 WHEN c_custkey % 6 = 0 THEN 0 ELSE (c_custkey % 10 = 3)::INT + (c_custkey % 9 = 5)::INT + (c_custkey % 8 = 2)::INT END AS verdict FROM customer)
  SELECT k AS c_custkey, CASE WHEN NOT there THEN 'not started' WHEN k % 6 IN (1, 4, 5) THEN 'PASS' WHEN k % 6 = 2 THEN 'FAIL' ELSE 'in progress' END AS state, CASE WHEN there THEN 2 ELSE 0 END::BIGINT AS total,
    CASE WHEN there THEN g1 + g2 ELSE 0 END::INT AS n_incomplete, CASE WHEN there THEN unreadable + changed + verdict + CASE WHEN k % 6 IN (1, 4, 5) THEN g1 + g2 ELSE 0 END ELSE 0 END::INT AS n_problems FROM d""")
def audit_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = audit.check_forms(_forms(spark, sf_dir))
    return checked.select(F.col("form").alias("c_custkey"), "state", F.col("total").cast("long").alias("total"), F.size("incomplete").alias("n_incomplete"), F.size("problems").alias("n_problems"))


@query("SELECT o_orderkey, (o_orderkey % 90 + 1)::INT AS easy, (o_orderkey % 7 + 1)::INT AS hard FROM orders")
def tier_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.concat(F.lit("easy="), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(", hard ="), (F.col("o_orderkey") % 7 + 1).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", X.tier_counts(spec).alias("m"))
    return rows.select("o_orderkey", F.col("m")["easy"].alias("easy"), F.col("m")["hard"].alias("hard"))


@query("""SELECT l_linenumber AS tokenizer, count(*) AS probes, count(*) FILTER (l_returnflag <> l_linestatus) AS mismatches, bool_and(l_returnflag = l_linestatus) AS all_match FROM lineitem GROUP BY l_linenumber""")
def probe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("tokenizer"), F.array("l_returnflag").alias("a"), F.array("l_linestatus").alias("b"))
    return T.probe_report(rows)


@query("SELECT p_partkey, p_retailprice / (p_size + 1) * 4096.0::DOUBLE AS estimate FROM part")
def scaled_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scoring.scaled_estimate(F.col("p_retailprice"), F.col("p_size") + 1, F.lit(4096.0)).alias("estimate"))


@query(f"WITH {corpus_sql()} SELECT k AS ord, id, len(spans)::INT AS n FROM zh WHERE k % 3 = 0 UNION ALL SELECT k, id, 0 FROM zh WHERE k % 3 <> 0")
def completed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanframe.sources.sinks import completed_predictions as complete

    rows = corpus(spark, sf_dir).withColumnRenamed("k", "ord")
    return complete(rows, rows.where("ord % 3 = 0").select("id", F.col("entities").cast(SPANS).alias("spans"))).select("ord", "id", F.size("spans").alias("n"))


__all__ = ["LABELS", "ORACLE_SQL", "QUERIES"]
