"""Scoring of any number of systems against gold spans in one plan.

Gold and predictions meet once by id; each row gives counts of its labels under both rules by array functions, and one
shuffle of small counts serves totals by label, by tier and overall through grouping sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.match import label_counts
from spanframe.functions.text import half_even
from spanframe.model import RULES, SCORED_TIERS, no_spans


#: Systems that one plan compares; each needs the gold rows once.
MOST_SYSTEMS = 1000


def join_predictions(gold: DataFrame, predictions: DataFrame, systems: DataFrame | None = None) -> DataFrame:
    """(system, id, text, tier, gold, pred): every gold row for every system, a missing prediction as no spans.

    The systems are a dimension whose size is checked: more than MOST_SYSTEMS are an error. Predictions grow with the rows
    and are merged, never broadcast: of rows made from keys Spark's estimate is that of the keys, however much is made of them.
    """
    systems = (systems if systems is not None else predictions).select("system").distinct()
    names = [r.system for r in systems.limit(MOST_SYSTEMS + 1).collect()]
    if len(names) > MOST_SYSTEMS:
        raise ValueError(f"over {MOST_SYSTEMS} systems; score them in parts")
    each = F.explode(F.array(*[F.lit(x) for x in sorted(names)]).cast("array<string>"))
    wanted = gold.select(each.alias("system"), "id", "text", "tier", F.col("spans").alias("gold"))
    found = predictions.select("system", "id", F.col("spans").alias("pred"))
    return wanted.join(found.hint("merge"), ["system", "id"], "left").withColumn("pred", F.coalesce("pred", no_spans()))


def row_counts(joined: DataFrame) -> DataFrame:
    """(system, id, tier, rule, label, tp, fp, fn) for each of the labels; spans of other labels don't count."""
    cells = joined.select("system", "id", "tier", F.explode(label_counts(F.col("gold"), F.col("pred"))).alias("x"))
    return cells.select("system", "id", "tier", "x.rule", "x.label", "x.tp", "x.fp", "x.fn")


def with_rates(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of tp, fp and fn: 0 where a denominator is 0, f1 of the unrounded rates, 4 digits half even."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("*", half_even(p).alias("precision"), half_even(r).alias("recall"), half_even(ratio(2 * p * r, p + r)).alias("f1"))


def score_by_label(counts: DataFrame) -> DataFrame:
    """(system, rule, label, tp, fp, fn, precision, recall, f1) for every label and 'micro', their sum."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    grouped = counts.groupingSets([["system", "rule", "label"], ["system", "rule"]], "system", "rule", "label").agg(*sums)
    return with_rates(grouped.withColumn("label", F.coalesce("label", F.lit("micro"))))


def score_by_tier(counts: DataFrame) -> DataFrame:
    """(system, rule, tier, f1): micro scores of each scored tier, all of them also where a tier has no rows."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    # one pass over the counts: what a system lacks is filled from its few sums, not from its rows once more
    have = counts.groupBy("system", "rule", "tier").agg(*sums)
    own = F.when(F.col("tier").isin(*SCORED_TIERS), F.struct("rule", "tier", "tp", "fp", "fn"))
    every = have.groupBy("system").agg(F.collect_list(own).alias("own")).select("*", F.explode(F.array(*map(F.lit, RULES))).alias("rule")).select("*", F.explode(F.array(*map(F.lit, SCORED_TIERS))).alias("tier"))
    cell = every.withColumn("c", F.get(F.filter("own", lambda x: (x["rule"] == F.col("rule")) & (x["tier"] == F.col("tier"))), F.lit(0)))
    return with_rates(cell.select("system", "rule", "tier", *[F.coalesce(f"c.{c}", F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))


def negatives(joined: DataFrame) -> DataFrame:
    """(system, n, fired, fpr): rows of the negative tier on which a system predicts a span of any label."""
    negative = F.col("tier") == "negative"
    out = joined.groupBy("system").agg(F.count_if(negative).alias("n"), F.count_if(negative & (F.size("pred") > 0)).alias("fired"))
    return out.withColumn("fpr", half_even(F.coalesce(F.try_divide("fired", "n"), F.lit(0.0))))


def false_per_1000(joined: DataFrame) -> DataFrame:
    """(system, fp, chars, false_per_1000): exact false positives of the labels over all tiers, per 1000 characters."""
    fp = F.aggregate(label_counts(F.col("gold"), F.col("pred"), ("exact",)), F.lit(0), lambda acc, c: acc + c["fp"])
    out = joined.select("system", F.length("text").alias("chars"), fp.alias("fp")).groupBy("system").agg(F.sum("fp").alias("fp"), F.sum("chars").alias("chars"))
    return out.withColumn("false_per_1000", half_even(F.coalesce(F.try_divide(1000 * F.col("fp"), "chars"), F.lit(0.0))))


def percentile_or(value: Column, share: float, empty: Column | None) -> Column:
    """Linear-interpolation percentile; `empty` where there are no values."""
    found = F.percentile(value, share)
    return found if empty is None else F.coalesce(found, empty)


def latency_summary(calls: DataFrame, warmup: int = 10, by: str = "system", order: str = "ord", value: str = "ms") -> DataFrame:
    """(by, p50, p95, mean, n, warmup) of the calls after the first `warmup` of each system; at most all of them warm up."""
    timed = calls.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    kept = F.when(F.col("place") > warmup, F.col(value))
    zero = F.lit(0.0)
    out = timed.groupBy(by).agg(
        half_even(percentile_or(kept, 0.5, zero)).alias("p50"), half_even(percentile_or(kept, 0.95, zero)).alias("p95"), half_even(F.coalesce(F.avg(kept), zero)).alias("mean"),
        F.count(kept).alias("n"), F.least(F.count("*"), F.lit(warmup)).alias("warmup"),
    )
    return out


def run_summary(runs: DataFrame, by: tuple[str, ...] = ("model", "condition")) -> DataFrame:
    """Summary of timed runs: how many succeeded, median and range of the load and first-call times, pooled latencies."""
    ok = F.col("error").isNull() & ~F.coalesce(F.col("timed_out"), F.lit(False))
    stats = lambda c: [F.median(F.when(ok, F.col(c))).alias(f"{c}_median"), F.min(F.when(ok, F.col(c))).alias(f"{c}_min"), F.max(F.when(ok, F.col(c))).alias(f"{c}_max")]
    per_run = runs.groupBy(*by).agg(F.count_if(ok).alias("ok_run_count"), *stats("cold_load_ms"), *stats("first_inference_ms"))
    pooled = runs.where(ok).select(*by, F.explode("latencies_ms").alias("ms")).groupBy(*by).agg(F.percentile("ms", 0.5).alias("latency_p50"), F.percentile("ms", 0.95).alias("latency_p95"), F.count("*").alias("latency_n"))
    return per_run.join(pooled, list(by), "left")


def scaled_estimate(measured_ms: Column, measured_bytes: Column, other_bytes: Column) -> Column:
    """A transfer time in proportion to the bytes."""
    return measured_ms / measured_bytes * other_bytes
