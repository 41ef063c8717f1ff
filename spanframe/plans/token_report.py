"""Reports of tokenizer comparisons and of timed runs: the operators over dumps and runs, put together as documents.

Both read files of any number of rows; what reaches the driver are rates by source and samples of a fixed size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.tokens import content_tokens
from spanframe.operators import tokens as T
from spanframe.operators.relational import append_runs
from spanframe.operators.scoring import run_summary

CAP, SAMPLES, TEXTS = 512, 20, 30


def by_source(rows: DataFrame, key: str = "source") -> dict[str, dict]:
    return {r[key]: {k: v for k, v in r.asDict(recursive=True).items() if k != key} for r in rows.collect()}


def aligned(dump: DataFrame) -> DataFrame:
    """The dump with truth, the true offsets of the content tokens, and these as tokens."""
    pairs = F.zip_with("offsets", "special_tokens_mask", lambda o, m: F.struct(o.alias("o"), m.alias("m")))
    truth = F.transform(F.filter(pairs, lambda p: p["m"] == 0), lambda p: F.struct(p["o"][0].alias("start"), p["o"][1].alias("end")))
    return dump.withColumns({"truth": truth, "tokens": F.coalesce("content_tokens", content_tokens(F.col("tokens"), F.col("special_tokens_mask")))})


def rebuilt(dump: DataFrame, name: str, fold: bool) -> dict:
    """Accuracy of offsets rebuilt from tokens, and the first tokens that they are wrong for."""
    rows = T.with_rebuilt(aligned(dump), fold=fold).withColumn("tokenizer", F.lit(name))
    scores = by_source(T.rebuilt_accuracy(rows), "tokenizer").get(name, {})
    wrong = T.rebuilt_mismatches(rows, SAMPLES).orderBy("place").drop("tokenizer", "place")
    return scores | {"mismatch_examples": [r.asDict(recursive=True) for r in wrong.collect()]}


def tokenizer_report(name: str, left: DataFrame, right: DataFrame) -> dict:
    """One tokenizer by two engines: parity of ids, token counts, unknown characters, rebuilt offsets of either engine's tokens."""
    left = left.withColumn("ord", F.row_number().over(Window.partitionBy("source").orderBy("id")) - 1)
    parity, stats, unknown = by_source(T.parity(left, right)), by_source(T.token_stats(left, CAP)), by_source(T.unknown_rate(left))
    first = T.first_mismatches(left, right, SAMPLES).groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"))
    over = T.over_cap(left, CAP).groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))
    texts = T.top_unknown(left, TEXTS, by="source").groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("texts"))
    for found, into, field in ((first, parity, "mismatch_ids"), (over, stats, "over_cap_ids")):
        ids = by_source(found)
        for source, values in into.items():
            values[field] = ids.get(source, {"ids": []})["ids"]
    shown = by_source(texts)
    for source, values in unknown.items():
        values["texts"] = shown.get(source, {"texts": []})["texts"]
    theirs = left.drop("tokens", "content_tokens").join(right.select("id", "tokens", "content_tokens"), "id")
    return {
        "parity": parity, "token_counts": stats, "unknown": unknown,
        "rebuilt": {engine: {"plain": rebuilt(rows, name, False), "folded": rebuilt(rows, name, True)} for engine, rows in (("left", left), ("right", theirs))},
    }


def token_report(dumps: dict[str, tuple[DataFrame, DataFrame]]) -> dict:
    """tokenizer_report() by tokenizer, of the dumps of two engines each."""
    return {name: tokenizer_report(name, *pair) for name, pair in dumps.items()}


def run_report(runs: list[DataFrame], run_id: str = "run_id") -> list[dict]:
    """Summaries of timed runs from several files by model and condition; a run that is in several files counts once."""
    merged = runs[0]
    for more in runs[1:]:
        merged = append_runs(merged, more, run_id)
    return [r.asDict() for r in run_summary(merged).orderBy("model", "condition").collect()]
