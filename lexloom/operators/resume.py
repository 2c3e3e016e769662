"""Files that earlier runs finished, kept as a table with the settings that they ran under."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = ["source_lang", "target_lang", "translate_code", "code_scope"]
SCHEMA = "path string, file_sha256 string, source_lang string, target_lang string, translate_code boolean, code_scope string"


def load(spark: SparkSession, folder: str, config: dict) -> DataFrame:
    """path and file_sha256 of what was done under the same four settings; nothing where there is no table or another one."""
    nothing = spark.createDataFrame([], "path string, file_sha256 string")
    try:
        held = spark.read.parquet(folder)
    except AnalysisException:
        return nothing
    if not {"path", "file_sha256", *CONFIG} <= set(held.columns):
        return nothing
    for field in CONFIG:
        held = held.filter(F.col(field) == F.lit(config[field]))
    return held.select("path", "file_sha256").distinct()


def save(done: DataFrame, folder: str, config: dict) -> None:
    """Adds (path, file_sha256) rows, in order of path, under the settings."""
    row = done.select("path", "file_sha256", *[F.lit(config[field]).alias(field) for field in CONFIG])
    row.sortWithinPartitions("path").write.mode("append").parquet(folder)
