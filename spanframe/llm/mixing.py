"""Mixing sources to target weights, with DataFrame functions alone.

Within a source, documents are drawn by Efraimidis-Spirakis sampling: a uniform draw u of the document's id gives the
exponential key -ln(u) / weight, and smaller keys come first, so a document of twice the weight is twice as likely to be
ahead. A source's target is first filled with complete epochs of the source; the rest is a fraction of an epoch, filled
in key order up to the budget. The order of a source is never sorted as a whole: sizes are summed in bins of keys, bins
below the budget are taken and bins above it are not, and the bin in which the budget ends is cut into bins once more;
only the small bin in which it ends then is sorted. Bins are equal on the scale of the key's logarithm, on which no
mixture of weights puts more than 0.37 of a source's documents into a unit: of the BINS bins, that is 0.4 % in the fullest
of the first cut and a BINS-th of that in the second, whatever the weights are.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; a null quality weight
counts as 1 and weights are held within 1/16 to 16; of rows with one id and equal keys the order is by id and size;
a source without words has target 0; a text without words is taken only with complete epochs; other columns are ignored
by mix(); draw_mix() gives rows that are alike in source, key, id and size as often as each other; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm.common import Scratch, checked_broadcast, text_or_empty

#: Bins of a cut, and the range of the keys' binary logarithms: u is a multiple of 2 ** -49, weights are 2 ** -4 to 2 ** 4.
BINS = 4096
LOWEST, HIGHEST = -54.0, 10.0
#: A source weighs WEIGHTS[its place modulo 3], places by code point.
WEIGHTS = (3, 1, 2)


def word_count(c: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`: the starts of words, counted by what follows white space."""
    spaced = F.translate(c, "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != ""))


def draw(doc_id: Column) -> Column:
    """A uniform number in (0, 1) that depends on the id alone."""
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double")
    return (digits + 0.5) / float(16**12)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The shared words are dealt by weight; a source whose part would exceed `most` times its size stops there, and the
    excess goes to the others by weight. In the order of size to weight, capped sources come first: each is capped if
    what is left for it and those after it would give it more than its cap.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    placed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place.cast("int"))).withColumn("cap", F.col("source_size") * float(most))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    ranked = placed.select(
        "source", "source_size", "w", "cap",
        (F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        F.sum("w").over(after).alias("rest"),
    )
    capped = ranked.withColumn("capped", F.col("cap") * F.col("rest") <= F.col("left") * F.col("w"))
    level = F.max(F.when(~F.col("capped"), F.struct(F.col("rest"), F.col("left")))).over(whole)
    level = level["left"] / level["rest"]
    return capped.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("w")).alias("target"))


def keyed(quality: Column | None, bins: int) -> dict[str, Column]:
    """The columns size, key, bin and part (the bin within the bin) of a document."""
    weight = F.least(F.greatest(F.coalesce(quality if quality is not None else F.lit(1.0), F.lit(1.0)).cast("double"), F.lit(1 / 16)), F.lit(16.0))
    key = -F.log(draw(F.col("doc_id"))) / weight
    place = F.floor((F.log2(key) - LOWEST) / (HIGHEST - LOWEST) * float(bins * bins))
    place = F.least(F.greatest(place, F.lit(0)), F.lit(bins * bins - 1))
    return {
        "size": word_count(text_or_empty()).cast("long"), "key": key,
        "bin": F.floor(place / bins).cast("int"), "part": F.pmod(place, F.lit(bins)).cast("int"),
    }


def _ending(sums: DataFrame, plan: DataFrame, by: str, bins: int) -> DataFrame:
    """plan (source s, budget left, ...) with the first bin whose sum passes what is left, and left less the words before it.

    sums: (source, by, words). Where no bin passes, the bin is `bins`: all are below it.
    """
    upto = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    summed = sums.withColumn("upto", F.sum("words").over(upto)).join(plan.select(F.col("s").alias("of"), F.col("left").alias("most")), F.col("source").eqNullSafe(F.col("of")))
    first = summed.where(F.col("upto") > F.col("most")).groupBy("of").agg(F.min(F.struct(F.col(by).alias("at"), (F.col("upto") - F.col("words")).alias("before"))).alias("first"))
    joined = plan.join(first, F.col("s").eqNullSafe(F.col("of")), "left").drop("of")
    return joined.withColumn(f"last_{by}", F.coalesce("first.at", F.lit(bins))).withColumn("left", F.col("left") - F.coalesce("first.before", F.lit(0))).drop("first")


def mix_plan(rows: DataFrame, scratch: Scratch, share: float, most: float, weights: tuple[int, ...], bins: int) -> DataFrame:
    """One row a source: s, source_size, target, epochs, and last_bin, last_part and left, in which the budget ends.

    rows: source, size, bin and part of each document.
    """
    binned = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    targets = source_targets(binned.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    plan = targets.withColumn("epochs", epochs.cast("int")).withColumnRenamed("source", "s")
    plan = plan.withColumn("left", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = scratch.save(_ending(binned, plan, "bin", bins), "bins")
    last = rows.join(checked_broadcast(plan.select(F.col("s").alias("of"), "last_bin")), F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("last_bin")))
    return scratch.save(_ending(last.groupBy("source", "part").agg(F.sum("size").alias("words")), plan, "part", bins), "plan")


#: Whether a document comes before the bin in which its source's budget ends, or lies in it.
AHEAD = "bin < last_bin or (bin = last_bin and part < last_part)"
WITHIN = "bin = last_bin and part = last_part"


def _at_the_end(joined: DataFrame) -> DataFrame:
    """The documents of the bins in which budgets end, with the words of each that are within its source's budget (more)."""
    within = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("left") - F.coalesce(F.sum("size").over(within), F.lit(0))
    return joined.where(WITHIN).withColumn("rest", rest).withColumn("more", F.greatest(F.least(F.col("rest"), F.col("size")), F.lit(0)))


def mix(docs: DataFrame, quality: Column | None = None, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, bins: int = BINS) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of each row: the words that the mix takes of it, repeats counted.

    The document over which a budget ends is taken in part; copies are whole passes, that part rounded to one or none.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.save(docs.select("doc_id", "source", *[c.alias(name) for name, c in keyed(quality, bins).items()]), "sizes")
    plan = mix_plan(rows, scratch, share, most, weights, bins)
    joined = rows.join(checked_broadcast(plan), F.col("source").eqNullSafe(F.col("s")))
    others = joined.where(f"not ({WITHIN})").withColumn("more", F.when(F.expr(AHEAD), F.col("size")).otherwise(0))
    out = others.unionByName(_at_the_end(joined).drop("rest"))
    copies = F.col("epochs") + (2 * F.col("more") >= F.greatest(F.col("size"), F.lit(1))).cast("int")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("epochs") * F.col("size") + F.col("more")).alias("taken"))


def draw_mix(docs: DataFrame, quality: Column | None = None, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, bins: int = BINS) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it as a whole; no text is shuffled.

    Where a source's budget ends is one place in its order, (key, doc_id, size), so each row tells its copies by itself.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    columns = keyed(quality, bins)
    rows = scratch.save(docs.select("doc_id", "source", *[c.alias(name) for name, c in columns.items()]), "sizes")
    plan = mix_plan(rows, scratch, share, most, weights, bins)
    joined = rows.join(checked_broadcast(plan), F.col("source").eqNullSafe(F.col("s")))
    place = F.struct("key", F.col("doc_id").isNotNull().alias("named"), "doc_id", "size").alias("place")
    # the first place that is not taken whole: taken as a whole if half of its words are
    ends = _at_the_end(joined).groupBy("s", place).agg(F.sum("more").alias("more"), F.sum("size").alias("words"))
    ends = ends.where("more < words").groupBy("s").agg(F.min(F.struct("place", (2 * F.col("more") >= F.col("words")).alias("whole"))).alias("end"))
    plan = plan.join(ends.withColumnRenamed("s", "of"), F.col("s").eqNullSafe(F.col("of")), "left").drop("of")
    plan = scratch.save(plan.select("s", "epochs", "last_bin", "last_part", "end"), "ends")

    whole = docs.select(F.struct("*").alias("row"), "doc_id", "source", *[c.alias(name) for name, c in columns.items()])
    whole = whole.join(checked_broadcast(plan), F.col("source").eqNullSafe(F.col("s")))
    taken = F.col("end").isNull() | (place < F.col("end.place")) | ((place == F.col("end.place")) & F.col("end.whole"))
    more = F.expr(AHEAD) | (F.expr(WITHIN) & taken)
    copies = F.col("epochs") + (more & (F.col("size") > 0)).cast("int")
    return whole.select("row", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")
