"""Comparisons of token dumps: parity of two engines, token statistics, unknown tokens, rebuilt offsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.text import half_even
from spanframe.functions.tokens import normalised_or_plain, rebuild_offsets


def parity(left: DataFrame, right: DataFrame, ids: str = "input_ids") -> DataFrame:
    """(source, total, matches, mismatches, match_rate) by source and combined ('all'); a row that right lacks is a mismatch."""
    joined = left.select("id", "source", F.col(ids).alias("a")).join(right.select("id", F.col(ids).alias("b")), "id", "left")
    same = joined.withColumn("same", F.col("a").eqNullSafe(F.col("b")))
    out = same.groupingSets([["source"], []], "source").agg(F.count("*").alias("total"), F.count_if("same").alias("matches"))
    rate = half_even(F.try_divide("matches", "total"), 6)
    return out.select(F.coalesce("source", F.lit("all")).alias("source"), "total", "matches", (F.col("total") - F.col("matches")).alias("mismatches"), rate.alias("match_rate"))


def first_mismatches(left: DataFrame, right: DataFrame, n: int = 20, ids: str = "input_ids", order: str = "ord") -> DataFrame:
    """The first n rows of each source, in order, on which the engines differ."""
    joined = left.join(right.select("id", F.col(ids).alias("other_ids")), "id", "left").where(~F.col(ids).eqNullSafe(F.col("other_ids")))
    place = F.row_number().over(Window.partitionBy("source").orderBy(order, "id"))
    return joined.withColumn("place", place).where(F.col("place") <= n).select("source", "place", "id")


def token_stats(dump: DataFrame, cap: int = 512, by: str = "source") -> DataFrame:
    """Token counts by source: n, mean, p95, most, tokens a character, and how many rows exceed the cap.

    The mean of tokens a character counts an empty text as one character.
    """
    share = F.col("num_ids") / F.greatest(F.length("text"), F.lit(1))
    return dump.groupBy(by).agg(
        F.count("*").alias("n"), half_even(F.avg("num_ids")).alias("mean_tokens"), half_even(F.percentile("num_ids", 0.95)).alias("p95_tokens"),
        F.max("num_ids").cast("long").alias("max_tokens"), half_even(F.avg(share)).alias("tokens_per_char"), F.count_if(F.col("num_ids") > cap).alias("over_cap"),
    )


def unknown_rate(dump: DataFrame, by: str = "source") -> DataFrame:
    """(by, unk_chars, chars, rate): characters under unknown tokens, of all characters; null without characters."""
    under = F.aggregate("unk_char_spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    out = dump.groupBy(by).agg(F.sum(under).alias("unk_chars"), F.sum(F.length("text")).alias("chars"))
    return out.withColumn("rate", half_even(F.try_divide("unk_chars", "chars"), 6))


def top_unknown(dump: DataFrame, n: int = 30, order: str = "ord", by: str | None = None) -> DataFrame:
    """The n most frequent texts of unknown tokens, of each `by` if given; of equal counts the one that came first is first."""
    keys = [by] if by else []
    spans = dump.select(*keys, order, F.posexplode_outer("unk_char_spans").alias("at", "s")).where(F.col("s").isNotNull())
    counted = spans.select(*keys, F.struct(order, "at").alias("seen"), F.col("s.text").alias("text")).groupBy(*keys, "text").agg(F.count("*").alias("n"), F.min("seen").alias("first"))
    if by is None:
        return counted.orderBy(F.desc("n"), "first").limit(n).select("text", "n")
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first"))
    return counted.withColumn("place", place).where(F.col("place") <= n).select(by, "place", "text", "n")


def over_cap(dump: DataFrame, cap: int = 512, by: str = "source", order: str = "ord") -> DataFrame:
    """(by, order, id, num_ids) of the rows that exceed the cap, in order."""
    return dump.where(F.col("num_ids") > cap).select(by, order, "id", "num_ids").orderBy(by, order)


def with_rebuilt(rows: DataFrame, tokens: str = "tokens", fold: bool = False) -> DataFrame:
    """rows (text, tokens) with rebuilt, the offsets of the tokens' texts; with fold=True matched in the NFKC text.

    Fullwidth forms that a tokenizer folds are then found, as long as NFKC keeps the length of the row's text; else the text
    is taken as it is.
    """
    matched = rows.withColumn("matched_text", normalised_or_plain(F.col("text")) if fold else F.col("text"))
    return matched.withColumn("rebuilt", rebuild_offsets(F.col("matched_text"), F.col(tokens))).drop("matched_text")


#: Pairs of an entity and a token that are compared at once.
PAIRS = 1 << 22
_ROW_COUNTS = ("tokens", "tokens_right", "entities", "entities_right")


def _rebuilt_counts() -> Column:
    """struct of a row's tokens and entities, and how many of them were rebuilt rightly, over Arrow batches; null where the
    lists differ in length.

    An entity counts if true tokens cover it, and is right if what was rebuilt for the first and the last of these gives its
    very start and end. Tokens and entities of a batch are compared as whole columns, which costs about a twentieth of lambdas.
    """

    @F.arrow_udf("struct<" + ", ".join(f"{c}: int" for c in _ROW_COUNTS) + ">")
    def run(rebuilt: pa.Array, truth: pa.Array, entities: pa.Array) -> pa.Array:
        even = pc.fill_null(pc.equal(pc.list_value_length(rebuilt), pc.list_value_length(truth)), False)
        counts, unknown = _right_counts(*(x.filter(even) for x in (rebuilt, truth, entities)))
        kept = even.to_numpy(zero_copy_only=False)
        columns = []
        for c, missing in zip(counts, (False, False, unknown, unknown), strict=True):
            full, mask = np.zeros(len(kept), np.int32), ~kept
            full[kept], mask[kept] = c, missing
            columns.append(pa.array(full, mask=mask))
        return pa.StructArray.from_arrays(columns, names=list(_ROW_COUNTS))

    return run(F.col("rebuilt"), F.col("truth"), F.col("entities"))


def _right_counts(rebuilt: pa.ListArray, truth: pa.ListArray, entities: pa.ListArray) -> tuple[list[np.ndarray], np.ndarray]:
    """The four counts of rows whose lists are as long as each other, and where those of entities are unknown."""
    n, row, row_of_entity = len(truth), pc.list_parent_indices(truth).to_numpy(), pc.list_parent_indices(entities).to_numpy()
    found, true, entity = rebuilt.flatten(), truth.flatten(), entities.flatten()
    # numbers that are null become NaN, which compares as false
    numbers = lambda x, c: x.flatten()[x.type.get_field_index(c)].to_numpy(zero_copy_only=False)
    (r_start, r_end), (t_start, t_end), (e_start, e_end) = ([numbers(x, "start"), numbers(x, "end")] for x in (found, true, entity))
    same = lambda a, b: (a == b) | (np.isnan(a) & np.isnan(b))
    right = same(r_start, t_start) & same(r_end, t_end) & (found.is_valid().to_numpy(zero_copy_only=False) == true.is_valid().to_numpy(zero_copy_only=False))
    tokens = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(tokens)])
    # the entities' pairs with the tokens of their rows, a bounded number of pairs at once
    wide = tokens[row_of_entity] if len(entity) else np.zeros(0, np.int64)
    ends, covered, exact, at = np.cumsum(wide), np.zeros(len(entity), bool), np.zeros(len(entity), bool), 0
    while at < len(entity):
        before = ends[at] - wide[at]
        to = max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        which = np.repeat(np.arange(at, to), wide[at:to])
        token = np.arange(len(which)) - np.repeat(ends[at:to] - wide[at:to] - before - first[row_of_entity[at:to]], wide[at:to])
        hit = np.flatnonzero((t_start[token] < e_end[which]) & (t_end[token] > e_start[which]))
        own, begin = np.unique(which[hit], return_index=True)
        last = np.append(begin[1:], len(hit))[: len(begin)] - 1
        covered[own] = True
        exact[own] = (r_start[token[hit[begin]]] == e_start[own]) & (r_end[token[hit[last]]] == e_end[own])
        at = to
    of_row = lambda rows, mask: np.bincount(rows[mask], minlength=n)
    counts = [tokens, of_row(row, right), of_row(row_of_entity, covered), of_row(row_of_entity, exact)]
    return counts, (tokens > 0) & entities.is_null().to_numpy(zero_copy_only=False)


def rebuilt_accuracy(rows: DataFrame, by: str = "tokenizer") -> DataFrame:
    """Accuracy of rebuilt offsets (column rebuilt) against true ones (column truth), by token and by entity.

    Rows whose lists differ in length are left out and counted; so are entities that no true token covers.
    """
    counted = rows.select(by, (F.size("rebuilt") == F.size("truth")).alias("even"), _rebuilt_counts().alias("c"))
    out = counted.groupBy(by).agg(F.count("*").alias("rows"), F.count_if(~F.col("even")).alias("uneven"), *[F.sum(f"c.{c}").alias(c) for c in _ROW_COUNTS])
    return out.withColumns({"token_accuracy": half_even(F.try_divide("tokens_right", "tokens"), 6), "entity_accuracy": half_even(F.try_divide("entities_right", "entities"), 6)})


def rebuilt_mismatches(rows: DataFrame, n: int = 20, by: str = "tokenizer", order: str = "ord") -> DataFrame:
    """(by, place, id, token, rebuilt, truth): the first n tokens of each tokenizer that were rebuilt wrongly."""
    pairs = F.zip_with("rebuilt", "truth", lambda a, b: F.struct(a.alias("rebuilt"), b.alias("truth")))
    even = F.when(F.size("rebuilt") == F.size("truth"), pairs)
    # an outer generator, and no filter before it: what the lists are computed from would be pushed below, to be computed again
    each = rows.select(by, order, "id", F.posexplode_outer(even).alias("token", "p"))
    wrong = each.where(F.col("p").isNotNull() & ~F.col("p.rebuilt").eqNullSafe(F.col("p.truth")))
    place = F.row_number().over(Window.partitionBy(by).orderBy(order, "token"))
    return wrong.withColumn("place", place).where(F.col("place") <= n).select(by, "place", "id", "token", "p.rebuilt", "p.truth")


def probe_report(probes: DataFrame, by: str = "tokenizer") -> DataFrame:
    """(by, probes, mismatches, all_match) of paired encodings a and b."""
    same = F.col("a").eqNullSafe(F.col("b"))
    return probes.groupBy(by).agg(F.count("*").alias("probes"), F.count_if(~same).alias("mismatches"), F.bool_and(same).alias("all_match"))
