"""Joins, set operations and order-dependent operators that stand behind dictionaries and loops elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def named_and_ranked(results: DataFrame, names: DataFrame) -> DataFrame:
    """Results with the display name and rank of their key; names is a fixed dimension (key, name, rank)."""
    return results.join(F.broadcast(names), "key").orderBy("rank")


def without_blocked(names: DataFrame, blocked: DataFrame, column: str = "name") -> DataFrame:
    """Rows whose name no row of blocked has."""
    return names.join(blocked.select(F.col(column)).distinct(), column, "left_anti").select(*names.columns)


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a key, the new one where both have it; of several in one table the greatest."""
    both = old.select(key, F.lit(0).alias("turn"), *columns).unionByName(new.select(key, F.lit(1).alias("turn"), *columns))
    newest = both.groupBy(key).agg(F.max(F.struct("turn", *columns)).alias("row"))
    return newest.select(key, *[F.col(f"row.{c}").alias(c) for c in columns])


def append_runs(old: DataFrame, new: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Runs of both tables, each once, so that appending twice changes nothing."""
    return old.unionByName(new, allowMissingColumns=True).dropDuplicates([run_id])


def tagged_union(tables: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Rows of all tables with the name of theirs; columns that a table lacks are null."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def cell_population(rows: DataFrame, in_sample: Column | None = None) -> DataFrame:
    """(cell, n, in_sample): rows of each coverage cell, and of those that a sample holds, fewest first; one pass."""
    drawn = in_sample if in_sample is not None else F.lit(False)
    # an outer generator: with a plain one Spark would compute the cells once more below, to see that there are some
    cells = rows.select(drawn.alias("drawn"), F.explode_outer("cells").alias("cell")).where(F.col("cell").isNotNull()).groupBy("cell")
    return cells.agg(F.count("*").alias("n"), F.count_if("drawn").alias("in_sample")).orderBy("n", "cell")


def positional_differences(left: DataFrame, right: DataFrame, order: str = "number", value: str = "text") -> DataFrame:
    """(order, left, right) where two numbered lists differ, a missing place as null."""
    a, b = left.select(order, F.col(value).alias("left")), right.select(order, F.col(value).alias("right"))
    return a.join(b, order, "full").where(~F.col("left").eqNullSafe(F.col("right")))


def sections(lines: DataFrame, heading: Column, by: str, order: str = "number") -> DataFrame:
    """Lines with the last heading at or before them (column section), null before the first."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(upto))


def first_known(results: DataFrame, field: str, rank: str = "rank") -> DataFrame:
    """One row: the field of the first result that has it, else 'unknown'."""
    known = F.min_by(F.when(F.col(field).isNotNull(), F.col(field).cast("string")), F.when(F.col(field).isNotNull(), F.col(rank)))
    return results.agg(F.coalesce(known, F.lit("unknown")).alias(field))
