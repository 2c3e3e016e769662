"""Column functions on arrays: a value computed once, and running sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, work: Callable[[Column], Column]) -> Column:
    """``work`` of a value that is computed once, however often ``work`` names it."""
    return F.element_at(F.transform(F.array(value), work), 1)


def _sums(sizes: Column) -> Column:
    """struct(sums, total): the sum of what stands before each element of a short array."""
    start = F.struct(F.array().cast("array<long>").alias("sums"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(sizes, start, lambda a, x: F.struct(F.array_append(a["sums"], a["total"]).alias("sums"), (a["total"] + x).alias("total")))


def running(sizes: Column) -> Column:
    """The sum of what stands before each element, as longs.

    Groups of about the root of the length are summed alone and then moved by what stands before them, as an array that
    grows element by element costs the square of its length.
    """

    def grouped(all_: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_))).cast("int")
        count = F.ceil(F.size(all_) / width).cast("int")
        groups = F.transform(F.sequence(F.lit(0), count - 1), lambda k: _sums(F.slice(all_, k * width + 1, width)))
        moved = lambda g: F.zip_with(g, _sums(F.transform(g, lambda x: x["total"]))["sums"], lambda x, by: F.transform(x["sums"], lambda n: n + by))
        return F.flatten(let(groups, moved))

    return F.when(F.size(sizes) > 0, let(sizes, grouped)).otherwise(F.array().cast("array<long>"))
