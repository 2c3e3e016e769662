"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import discard, staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour of a node to the smallest one; ``large`` moves the larger neighbours only."""
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.unionByName(flipped) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(low, "a")
    moved = joined.filter(F.col("b") > F.col("a")) if large else joined
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge, as a staged table; root is the smallest node that it reaches.

    Each round is written to the shared folder, so a lost executor costs that round only; sums of the
    edges tell when nothing moves any more.
    """
    now = staged(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        before, now = now, staged(_stars(_stars(now, True), False), "edges")
        discard(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    out = staged(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), "roots")
    discard(now)
    return out
