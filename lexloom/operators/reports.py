"""Counts and summaries of runs, verifications, audits and reviews: one row each, or text made of few rows."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import translate, verify


def run_statistics(results: DataFrame) -> DataFrame:
    """Totals of (ok, action, translated_chars) rows, one for each file."""
    translated = F.col("ok") & (F.col("action") == "translated")
    return results.agg(
        F.count("*").alias("total_files"), F.count_if(translated).alias("translated_files"),
        F.count_if(F.col("ok") & ~translated).alias("skipped_files"), F.count_if(~F.col("ok")).alias("failed_files"),
        F.coalesce(F.sum(F.when(translated, F.col("translated_chars"))), F.lit(0)).cast("long").alias("translated_chars"),
    )


def seconds(start: Column, end: Column) -> Column:
    """From ``start`` to ``end``, or to now where it has not ended."""
    return (F.unix_micros(F.coalesce(end, F.current_timestamp())) - F.unix_micros(start)) / 1e6


def counters(source: DataFrame, target: DataFrame, reviewed: int = 0) -> DataFrame:
    """source_files, target_files, common_files, files_checked and ai_files_reviewed of a verification."""
    side = lambda df, k: verify.kept(df).select("path", F.lit(True).alias(k))
    both = side(source, "a").join(side(target, "b"), "path", "full_outer")
    common = F.count_if(F.col("a") & F.col("b"))
    return both.agg(F.count("a").alias("source_files"), F.count("b").alias("target_files"), common.alias("common_files"), common.alias("files_checked"), F.lit(reviewed).cast("long").alias("ai_files_reviewed"))


_ORDER = ["file", "type", "severity", "message", "source", "target"]


def report_lines(issues: DataFrame, counts: DataFrame, source: str, target: str) -> DataFrame:
    """``value``: the lines of a verification as one JSON document, whose partitions are in order.

    A header with the counts, a line for each issue in order of file and type, a trailer.  Issues are dealt by ranges and sorted within them;
    only the counts are gathered.
    """
    c = counts.first().asDict()
    told = issues.select("file", F.col("issue_type").alias("type"), "severity", "message", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("target", F.lit("")).alias("target"))
    summary = verify.worst(issues).crossJoin(issues.agg(F.count("*").alias("n"))).first()  # one row each
    head = {
        "source_dir": source, "target_dir": target,
        "files": {"source": c["source_files"], "target": c["target_files"], "common": c["common_files"], "checked": c["files_checked"], "ai_reviewed": c["ai_files_reviewed"]},
        "summary": {"issues": summary.n, "has_errors": summary.has_errors, "worst_severity": summary.worst_severity},
    }
    opened = json.dumps(head, ensure_ascii=False, indent=2).removesuffix("\n}") + ',\n  "issues": ['
    spark = issues.sparkSession
    line = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    placed = translate.batches(told, _ORDER, 1, 1)
    rows = placed.select(F.concat(F.when(F.col("ordinal") == 0, "    ").otherwise("   ,"), F.to_json(F.struct(*_ORDER), {"ignoreNullFields": "false"})).alias("value"))
    return line(opened).unionByName(rows).unionByName(line("  ]\n}"))


def write_report(lines: DataFrame, path: str) -> None:
    """The document as a folder of text files whose names keep the order, or, where the path ends so, as one ``.json`` file by rename.

    Lines stream through; the driver holds those of one partition at a time.
    """
    if not path.endswith(".json"):
        lines.write.mode("overwrite").text(path)
        return
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        for r in lines.toLocalIterator():
            f.write(r.value + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.part", path)


def first(rows: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows in order, each with how many ``more`` there are beyond them."""
    total = rows.agg(F.count("*").alias("_n"))
    return rows.orderBy(*order).limit(n).join(F.broadcast(total)).withColumn("more", F.greatest(F.col("_n") - n, F.lit(0))).drop("_n")


def audit_summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("total_findings"), F.count_distinct("path").alias("files_with_residual"))


def unaudited(files: DataFrame) -> DataFrame:
    """Paths of files that can't be read as UTF-8, in order."""
    return files.filter(~F.is_valid_utf8(F.col("content").cast("string"))).select("path").orderBy("path")


def by_type(issues: DataFrame, n: int = 3) -> DataFrame:
    """issue_type, count, the first ``n`` issues of each type as text, and how many more there are."""
    order = F.row_number().over(Window.partitionBy("issue_type").orderBy("file", "message"))
    told = F.concat_ws(": ", "file", F.left("message", F.lit(100)))
    shown = F.array_sort(F.collect_list(F.when(F.col("place") <= n, F.struct("place", told.alias("text")))))
    grouped = issues.withColumn("place", order).groupBy("issue_type").agg(F.count("*").alias("n"), F.transform(shown, lambda x: x["text"]).alias("shown"))
    return grouped.withColumn("more", F.greatest(F.col("n") - n, F.lit(0)))


def summary(issues: DataFrame, counts: DataFrame) -> str:
    """A verification as text."""
    c = counts.first().asDict()
    lines = [f"{k.replace('_', ' ')}: {v}" for k, v in c.items()]
    groups = by_type(issues).orderBy("issue_type").collect()
    lines.append(f"issues: {sum(g.n for g in groups)}")
    for g in groups:
        lines += [f"[{g.issue_type}] {g.n}", *(f"  {t}" for t in g.shown)]
        if g.more:
            lines.append(f"  and {g.more} more")
    return "\n".join(lines)


def language_rows(files: DataFrame, language: Column, text: Column) -> DataFrame:
    """path, language (unknown where none is found) and the percentage of Chinese, Japanese and Korean characters."""
    return files.select("path", F.coalesce(language, F.lit("unknown")).alias("language"), T.broad_percent(text).alias("cjk_percent"))
