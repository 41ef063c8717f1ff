"""Exact deduplication that no large group of copies can slow down.

Three stages combine rows, and each groups by digest and by the full normalised text, so that equal digests of
different texts never meet: (1) the partial aggregate of a scan task keeps one row for each text it has seen;
(2) these meet under (digest, salt), the salt being that of the scan task, so a group reaches at most `salts` tasks
and each gets one row of it from a scan task; (3) the salt winners, at most `salts` for a text, meet under the
digest. The decisions go back to the rows by digest: groups of at least 1/1000 of all rows, of which there are at
most 1000, are broadcast, and all others are joined by a shuffle in which no key has more than that share. Where one
digest stands for several texts, rows of that digest are matched by their text as well.

Defined cases: a null text counts as empty; of equal texts the row with the most code points, then the smallest
doc_id stays, and a null doc_id comes after all others; rows that repeat a doc_id and a text get the same answer
each; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import SPACE, Scratch, by_hot_key, checked_broadcast, text_or_empty

SALTS = 64


def normalised(c: Column) -> Column:
    return F.translate(c, SPACE, "")


def exact_groups(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = lambda c: F.sha2(c, 256)) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row; digest can be any function of the normalised text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    rows = docs.select(F.col("doc_id"), F.length(text_or_empty()).alias("size"), normalised(text_or_empty()).alias("norm"))
    rows = rows.withColumn("digest", digest(F.col("norm")))

    salt = (F.spark_partition_id() % salts).alias("salt")
    best = F.min(F.struct((-F.col("size")).alias("minus_size"), F.col("doc_id").isNull().alias("unnamed"), "doc_id")).alias("best")
    salted = rows.groupBy("digest", salt, "norm").agg(best, F.count("*").alias("n"))
    winners = salted.groupBy("digest", "norm").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    winners = winners.select("digest", "norm", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.sha2("norm", 256).alias("text_sha256"))
    # text goes on only where a digest has several
    by_digest = winners.groupBy("digest").agg(
        F.count("*").alias("texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), F.first("text_sha256").alias("text_sha256"), F.sum("group_size").alias("rows")
    )
    by_digest = scratch.save(by_digest, "digests")
    total = by_digest.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.max("texts"))
    n_rows, most_texts = total.first()

    light = rows.select("doc_id", "digest")
    out = by_hot_key(light, by_digest.where("texts = 1").drop("texts"), "digest", n_rows)
    out = out.select("doc_id", "keep_id", "group_size", "text_sha256")
    if (most_texts or 1) > 1:
        several = by_digest.where("texts > 1").select("digest")
        texts = winners.join(several, "digest", "left_semi").select("digest", "norm", "keep_id", "group_size", "text_sha256")
        exact = rows.join(checked_broadcast(several), "digest", "left_semi").join(texts, ["digest", "norm"])
        out = out.unionByName(exact.select("doc_id", "keep_id", "group_size", "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat one doc_id and text, one stays."""
    scratch = Scratch(docs.sparkSession, "copies")
    groups = scratch.save(exact_groups(docs).select("doc_id", "kept", "text_sha256"), "groups")
    gone = groups.where("not kept").select("doc_id", "text_sha256").distinct()
    twice = groups.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").drop("count")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.sha2(normalised(text_or_empty()), 256).alias("sha"))
    same = lambda other: F.col("id").eqNullSafe(other["doc_id"]) & (F.col("sha") == other["text_sha256"])
    gone, n_twice = checked_broadcast(gone), twice.count()
    kept = keyed.join(gone, same(gone), "left_anti")
    if n_twice:
        twice = checked_broadcast(twice, n_twice)
        kept = kept.join(twice, same(twice), "left_anti").unionByName(kept.join(twice, same(twice), "left_semi").dropDuplicates(["id", "sha"]))
    return kept.select("row.*")
