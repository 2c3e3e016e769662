"""Putting targets into files byte by byte, with guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T


def overlaps(segments: DataFrame) -> DataFrame:
    """Paths in which a segment begins before the one before it has ended."""
    following = F.lead("start_byte").over(Window.partitionBy("path").orderBy("start_byte", "end_byte"))
    return segments.withColumn("_next", following).filter("_next < end_byte").select("path").distinct()


def splice(files: DataFrame, segments: DataFrame) -> DataFrame:
    """path, status, content and applied of every file that has segments.

    status: ok, mismatch (the file is not the one extracted from), overlap or drift (the bytes are not the source
    text); files with a fault keep their content.  A file's gaps and targets are joined once.
    """
    row = F.struct("start_byte", "end_byte", "source_text", "target_text", "file_sha256")
    filled = F.collect_list(F.when(F.col("target_text").isNotNull(), row))
    grouped = segments.groupBy("path").agg(F.array_sort(F.collect_list(row)).alias("s"), F.array_sort(filled).alias("w"), F.count("target_text").alias("n"))
    joined = files.select("path", "content").join(grouped, "path")
    cut = lambda a, n: F.substring(F.col("content"), a.cast("int"), n.cast("int"))
    starts = F.transform("s", lambda x: x["start_byte"])
    shifted = F.slice(F.concat(starts, F.array(F.lit(None).cast("long"))), F.lit(2), F.size("s"))
    overlap = F.exists(F.zip_with("s", shifted, lambda x, n: F.coalesce(n < x["end_byte"], F.lit(False))), lambda x: x)
    drift = F.exists("s", lambda x: cut(x["start_byte"] + 1, x["end_byte"] - x["start_byte"]) != F.encode(x["source_text"], "UTF-8"))
    # gaps and targets in turn, as strings that keep any bytes, joined once
    ends = F.transform("w", lambda x: x["end_byte"])
    begins = F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))))
    pairs = F.zip_with("w", begins, lambda x, at: F.concat(cut(at + 1, x["start_byte"] - at).cast("string"), x["target_text"]))
    tail = F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0).cast("long"))
    spliced = F.concat(F.array_join(pairs, ""), cut(tail + 1, F.length("content") - tail).cast("string")).cast("binary")
    status = F.when(F.col("s")[0]["file_sha256"] != F.sha2("content", 256), "mismatch").when(overlap, "overlap").when(drift, "drift").otherwise("ok")
    # the status is computed once, in a column of its own
    judged = joined.withColumn("status", status)
    ok = F.col("status") == "ok"
    return judged.select("path", "status", F.when(ok, spliced).otherwise(F.col("content")).alias("content"), F.when(ok, F.col("n").cast("int")).otherwise(0).alias("applied"))


def statistics(spliced: DataFrame) -> DataFrame:
    """One row of counts; a file that passes all guards counts as spliced, with or without targets."""
    count = lambda status: F.count_if(F.col("status") == status)
    ok = F.col("status") == "ok"
    return spliced.agg(
        F.count("*").alias("files_processed"), count("ok").alias("files_spliced"), count("mismatch").alias("files_skipped_mismatch"),
        count("invalid").alias("files_skipped_validation"), F.coalesce(F.sum(F.when(ok, F.col("applied"))), F.lit(0)).cast("long").alias("segments_applied"),
    )


class ApplyError(ValueError):
    """A manifest that does not fit its files."""


def check(spliced: DataFrame, segments: DataFrame, skip_mismatch: bool = False) -> None:
    """Raises for files that are missing, overlap or drift, or no longer are what they were; mismatches can be skipped instead."""
    faulty = spliced.filter(F.col("status").isin(["overlap", "drift"] + ["mismatch"] * (not skip_mismatch))).select("path", "status")
    missing = segments.select("path").distinct().join(spliced.select("path"), "path", "left_anti").select("path", F.lit("missing").alias("status"))
    first = faulty.unionByName(missing).orderBy("path").limit(20).collect()
    if first:
        raise ApplyError("; ".join(f"{r.path}: {r.status}" for r in first))


def validated(spliced: DataFrame, files: DataFrame) -> DataFrame:
    """Structured files that no longer parse keep their original content."""
    from lexloom.operators.parsers import syntax_errors

    bad = syntax_errors(spliced).filter(F.col("error").isNotNull() & T.suffix(F.col("path")).isin(".json", ".yaml", ".yml", ".toml", ".py"))
    old = files.select("path", F.col("content").alias("old")).join(bad.select("path"), "path", "left_semi")
    out = spliced.join(old, "path", "left")
    return out.withColumns({"status": F.when(F.col("old").isNotNull(), "invalid").otherwise(F.col("status")), "content": F.coalesce("old", "content")}).drop("old")
