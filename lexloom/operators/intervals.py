"""Intervals [start, end) of groups: which rows lie clear of all covers, by one sweep that may be cut anywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.translate import staged


def outside(rows: DataFrame, covers: DataFrame, by: str = "path", start: str = "start_byte", end: str = "end_byte", stage: Callable[[DataFrame], DataFrame] = staged) -> DataFrame:
    """The ``rows`` that overlap no interval of ``covers`` in their group: an anti join on ``cover.start < row.end and row.start < cover.end``.

    A row overlaps some cover if of the covers that begin before its end the furthest ends after its start.  So covers by their
    starts and rows by their ends are put in one order, and a running maximum of ends decides.  The order is dealt by ranges of (group,
    place): within a range the maximum is a window, and the maxima of ranges, one row each, are carried to the ranges after them, so a group
    that holds most rows is the work of many tasks and no pairs are formed.  Rows with a null group or bound overlap nothing.
    """
    clear = F.lit(None).cast("long")
    events = covers.select(F.col(by).alias("_by"), F.col(start).alias("_at"), F.lit(1).alias("_kind"), F.col(end).alias("_end"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("_row"))
    # at one place rows come before covers, as a cover that begins where a row ends does not touch it
    own = rows.select(F.col(by).alias("_by"), F.col(end).alias("_at"), F.lit(0).alias("_kind"), clear.alias("_end"), F.struct("*").alias("_row"))
    events = events.filter("_by is not null and _at is not null and _end is not null and _at < _end").unionByName(own)
    order = ["_by", "_at", "_kind"]
    dealt = stage(events.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    upto = Window.partitionBy("_by", "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy("_by", "_part").agg(F.max("_end").alias("_most")).withColumn("_carried", F.max("_most").over(earlier)).drop("_most")
    told = dealt.withColumn("_seen", F.max("_end").over(upto)).join(carried, ["_by", "_part"], "left")
    furthest = F.greatest("_seen", "_carried")
    return told.filter((F.col("_kind") == 0) & ~F.coalesce(furthest > F.col(f"_row.{start}"), F.lit(False))).select("_row.*")
