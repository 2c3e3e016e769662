"""From raw documents to token ids: quality, near-duplicates, benchmark leaks, personal data, encoding.

Each stage is written as Parquet into the shared folder and read back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import op5_jaccard_join, op6_quality, op7_pii, op8_decontaminate, op9_bpe_codec
from lexloom.llm.common import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grade classifier selects; it learns from the labelled ones among them.

    Null and empty texts are judged by their empty features; repeated rows are judged alike; without usable labels
    all stay; an empty table stays empty; all columns stay.
    """
    return op6_quality.select(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; of rows with equal doc_id the smallest (text first, then
    the other columns in order).

    Documents without words are groups of their own.  Rows without doc_id can't be told apart and stay; an empty table stays
    empty; all columns stay.
    """
    groups = staged(op5_jaccard_join.near_duplicates(docs), "pipeline-groups")
    first = groups.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("least")).agg(F.count("*").alias("rows"))
    first = staged(first, "pipeline-first")
    dropped = groups.filter("doc_id <> component_id").select("doc_id")
    # rows whose doc_id may be a dropped one or stand twice are joined; the others stay without a shuffle of their texts
    unsure = op5_jaccard_join.cells(dropped.unionByName(first.filter("rows > 1").select(F.col("least").alias("doc_id"))))
    sure, asked = (op5_jaccard_join.in_cells(docs.filter("doc_id is not null"), unsure, hit) for hit in (False, True))
    chosen = lambda condition: asked.join(first.filter(condition).select("least"), F.col("doc_id") == F.col("least"), "left_semi")
    kept = sure.unionByName(chosen("rows = 1"))
    if first.filter("rows > 1").limit(1).count():
        order = ["text", *[c for c in docs.columns if c != "text"]]
        least = chosen("rows > 1").groupBy("doc_id").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in order])).alias("_row"))
        kept = kept.unionByName(least.select("_row.*"))
    return kept.unionByName(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows are judged alike, all columns stay."""
    return op8_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data generalised and terms that give it away removed.

    Null and empty texts stay as they are; repeated rows are rewritten alike and count each as a document; all columns stay.
    """
    return op7_pii.sanitise(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and n_tokens of every document.

    Null and empty texts have no ids; repeated rows are encoded row by row; other columns end here.
    """
    return op9_bpe_codec.encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", encoding),
]

#: SQL expresses neither the classifier nor edit matching nor the encoder; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
