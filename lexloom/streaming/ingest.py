"""Segments of files as they arrive: new and changed files of a folder of Parquet tables, batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators import extract, parsers, translate

SOURCE_DDL = "path string, content binary"
COLUMNS = ["path", "kind", "start_byte", "end_byte", "source_text", "line", "column", "context_before", "context_after", "file_sha256", "id", "source_sha256", "translation_key", "target_text"]


def arriving(spark: SparkSession, source: str, files_per_batch: int = 64, forget: str | None = None) -> DataFrame:
    """A stream of (path, content, length, file_sha256, arrived) of files that are new or hold what they have not held before.

    Which (path, file_sha256) have come is the state of the stream, kept by their hash partition; without ``forget`` it grows with the
    number of versions.  With it (such as ``30 days``) a version counts as new again when that time has gone by since it came.
    """
    came = spark.readStream.schema(SOURCE_DDL).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    told = came.filter("path is not null and content is not null").select("path", "content", F.length("content").cast("long").alias("length"), F.sha2("content", 256).alias("file_sha256"), F.current_timestamp().alias("arrived"))
    if forget is None:
        return told.dropDuplicates(["path", "file_sha256"])
    return told.withWatermark("arrived", forget).dropDuplicatesWithinWatermark(["path", "file_sha256"])


def segments_of(files: DataFrame, suffixes: Sequence[str] | None = None) -> DataFrame:
    """Segments of files with a parser by that, of others line by line; those of one file do not overlap."""
    known = {s: p for s, p in parsers.PARSERS.items() if suffixes is None or s in suffixes}
    parsed = extract.T.suffix(F.col("path")).isin(list(known))
    han = extract.T.has_han(F.col("source_text"))
    found = parsers.parse_all(files.filter(parsed), known).filter("kind is not null and accepted and translatable").filter(han)
    plain = files.filter(~parsed & F.is_valid_utf8(F.col("content").cast("string"))).withColumn("src", F.col("content").cast("string"))
    spans = extract.line_segments(plain, placed=True)
    return extract.build_segments(found.select(*spans.columns).unionByName(spans)).select(*COLUMNS)


def segments_stream(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 64, forget: str | None = None) -> StreamingQuery:
    """Writes what has come to ``source`` into ``target``, then ends: ``files`` (path, file_sha256) and their ``segments``.

    Each batch has folders of its own that are overwritten when a batch is repeated, so results appear once whatever
    fails; ``checkpoint`` remembers what was read and which versions of files have come, so a file that comes again unchanged
    gives nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        files = translate.staged(batch)
        # the list of files is written last: a batch counts when it is there
        segments_of(files).write.mode("overwrite").parquet(f"{target}/segments/batch={number}")
        files.select("path", "file_sha256").write.mode("overwrite").parquet(f"{target}/files/batch={number}")

    stream = arriving(spark, source, files_per_batch, forget)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_segments(spark: SparkSession, target: str) -> DataFrame:
    """The segments of the last version of each file; a file that has lost its segments has none."""
    files = spark.read.option("basePath", f"{target}/files").parquet(f"{target}/files").groupBy("path").agg(F.max_by("file_sha256", F.struct("batch", "file_sha256")).alias("file_sha256"), F.max("batch").alias("batch"))
    segments = spark.read.option("basePath", f"{target}/segments").parquet(f"{target}/segments")
    return segments.join(files, ["path", "file_sha256", "batch"], "left_semi").drop("batch")
