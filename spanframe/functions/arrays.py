"""Helpers over arrays in a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body and its lambdas use it."""
    return F.transform(F.array(value), body)[0]


def _running(numbers: Column, start: Column) -> Column:
    zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out"))
    return F.aggregate(numbers, zero, step, lambda acc: acc["out"])


def running_sums(numbers: Column) -> Column:
    """The sums of the first 1, 2, ... of an array<int>.

    A fold that appends copies what it has at each step. A long array is therefore summed in chunks of about the square
    root of its length, each from the sum of the chunks before it, which keeps the copies of n numbers to n * sqrt(n).
    """

    def long(x: Column) -> Column:
        size = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.size(x))).cast("int"))
        cut = let(size, lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / c).cast("int")), lambda i: F.slice(x, i * c + 1, c)))

        def summed(chunks: Column) -> Column:
            before = _running(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, n: a + n)), F.lit(0))
            return let(before, lambda b: F.flatten(F.transform(chunks, lambda c, i: _running(c, F.when(i == 0, F.lit(0)).otherwise(b[i - 1])))))

        return let(cut, summed)

    return let(numbers, lambda x: F.when(F.size(x) <= CHUNK, _running(x, F.lit(0))).otherwise(long(x)))
