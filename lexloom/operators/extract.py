"""Extraction of segments: line by line, Markdown, and by parsers; greedy choice among overlaps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom import fixed_values as V
from lexloom.functions import text as T
from lexloom.operators import parsers as P
from lexloom.operators import scan
from lexloom.operators.translate import staged

SPAN = "path string, kind string, start_byte long, end_byte long, source_text string"


def build_segments(spans: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Keys and ids of spans; with ``files`` (path, content) also line, column, contexts and the file's digest.

    With ``files``, spans are gathered by path and meet their file once; those that do not give their text back are left out.
    Spans of :func:`line_segments` and of parsers know their places already.
    """
    out = spans
    if files is not None:
        grouped = spans.groupBy("path").agg(F.collect_list(F.struct(*[c for c in spans.columns if c != "path"])).alias("spans"))
        placed = P.place_spans(files.select("path", "content").join(grouped, "path"))
        each = placed.select("path", "file_sha256", F.inline(F.arrays_zip("spans", "places")))
        out = each.filter("places is not null").select("path", "spans.*", "file_sha256", *[f"places.{c}" for c in ("line", "column", "context_before", "context_after")])
    return out.withColumns({
        "id": T.segment_id(F.col("path"), F.col("start_byte"), F.col("end_byte")),
        "source_sha256": F.sha2("source_text", 256),
        "translation_key": T.translation_key(F.col("source_text"), F.col("kind")),
        "target_text": F.lit(None).cast("string"),
    })


def violations(segments: DataFrame) -> DataFrame:
    """Segments that break the row constraints, with the reason."""
    return segments.withColumn("reason", T.segment_fault()).filter("reason is not null")


def line_segments(files: DataFrame, text: str = "src", placed: bool = False) -> DataFrame:
    """Every line with Han characters, without the white space around it.

    With ``placed`` also line, column, contexts and file_sha256, told in the pass over each text.
    """
    some = files.filter(T.has_han(F.col(text)))
    if placed:
        found = P.parse_each(some.select("path", F.encode(text, "UTF-8").alias("content")), P.lines)
        return found.drop("translatable", "reason", "protected_context", "accepted")
    return scan.lines(some.select("path", text), text, T.has_han).select("path", *_body(F.col("line"), F.col("start_byte")))


def _body(line: Column, start_byte: Column) -> list[Column]:
    """kind, start_byte, end_byte and source_text of a line without the white space around it."""
    body, start = T.strip_u(line), start_byte + F.octet_length(F.regexp_extract(line, r"(?U)^(\s*)", 1))
    return [F.lit("string").alias("kind"), start.alias("start_byte"), (start + F.octet_length(body)).alias("end_byte"), body.alias("source_text")]


def markdown_segments(files: DataFrame, text: str = "src") -> DataFrame:
    """Headings, paragraphs, table cells and link labels of Markdown text, whatever its suffix; overlaps are resolved greedily."""
    found = P.parse_each(files.select("path", F.encode(text, "UTF-8").alias("content")), P.markdown)
    return found.filter("accepted").select("path", "kind", "start_byte", "end_byte", "source_text")


def greedy(spans: DataFrame) -> DataFrame:
    """In order of start, the spans that begin where the last accepted one has ended or later; one pass over sorted rows."""
    return overlapping(spans).filter("accepted").drop("accepted")


def overlapping(spans: DataFrame) -> DataFrame:
    """``spans`` with whether each is ``accepted``: it is translatable (where there is such a column) or not, and begins
    where the last accepted translatable one has ended or later.  Rows of a file are read in order, link labels after others.
    """
    names, schema = spans.columns, StructType([*spans.schema, *StructType.fromDDL("accepted boolean")])
    judged = "translatable" in names

    def run(batches):
        path, upto = None, 0
        for batch in batches:
            accepted = []
            advance = batch.column(names.index("translatable")).to_pylist() if judged else [True] * batch.num_rows
            for p, a, b, told in zip(*(batch.column(names.index(c)).to_pylist() for c in ("path", "start_byte", "end_byte")), advance):
                if p != path:
                    path, upto = p, 0
                accepted.append(a >= upto)
                if a >= upto and told:
                    upto = b
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(accepted, pa.bool_())], names=[*names, "accepted"])

    rank = F.when(F.col("kind") == "markdown_link_label", 1).otherwise(0)
    ordered = spans.repartition("path").sortWithinPartitions("path", "start_byte", rank, "end_byte", "kind", "source_text")
    return ordered.mapInArrow(run, schema)


@dataclass
class Extraction:
    """Segments of a tree, and why other spans and files gave none."""

    segments: DataFrame
    skipped: DataFrame
    fallback: DataFrame
    errors: DataFrame


def extract_files(
    files: DataFrame, include=None, exclude=None, translate_code: bool = False, source_is_cjk: bool = True, parsers=None, stage: Callable[[DataFrame], DataFrame] = staged
) -> Extraction:
    """EXTRACT of files (path, content, length): choice, decoding, a parser by suffix, no overlaps, the gate.

    ``errors`` (path, reason) are files that are not UTF-8; ``fallback`` (path, reason) those that were read line by line, as
    no parser knows their suffix or theirs failed; ``skipped`` (path, start_byte, snippet, reason) are spans that
    overlap an earlier one, are not to be translated, or have no Han characters where ``source_is_cjk``.  Spans are
    written down once (``stage``), as all four tables come from them.
    """
    known = P.PARSERS if parsers is None else {s: P.markdown for s in V.MARKDOWN_SUFFIXES} | parsers
    chosen = files.filter(scan.should_translate(F.col("path"), F.col("length"), include, exclude, translate_code))
    text, suffix = F.col("content").cast("string"), T.suffix(F.col("path"))
    errors = chosen.filter(~F.is_valid_utf8(text)).select("path", F.lit("not UTF-8").alias("reason"))
    texts = chosen.filter(F.is_valid_utf8(text)).select("path", "content", F.decode("content", "UTF-8").alias("src"), suffix.alias("suffix"))
    parsed = F.col("suffix").isin(list(known))
    found = stage(P.parse_all(texts.filter(parsed), known))
    failed = found.filter("kind is null").select("path", "reason")
    plain = texts.filter(~parsed)
    other = plain.select("path", F.lit("no parser").alias("reason")).unionByName(failed)
    by_line = line_segments(plain.select("path", "src").unionByName(texts.filter(parsed).join(failed, "path", "left_semi").select("path", "src")), placed=True)
    whole = {"translatable": F.lit(True), "accepted": F.lit(True), "reason": F.lit(""), "protected_context": F.lit(None).cast("array<string>")}
    judged = found.filter("kind is not null").unionByName(by_line.withColumns(whole))
    reason = F.when(~F.col("accepted"), "overlapping range").when(~F.col("translatable"), F.col("reason"))
    if source_is_cjk:
        reason = reason.when(~T.has_han(F.col("source_text")), "no Han characters")
    told = stage(judged.withColumn("reason", reason))
    skipped = told.filter("reason is not null").select("path", "start_byte", F.left("source_text", F.lit(60)).alias("snippet"), "reason")
    kept = told.filter("reason is null").drop("reason", "translatable", "accepted")
    return Extraction(build_segments(kept), skipped, other, errors)


def decoded(content: Column, errors: str = "ignore") -> Column:
    """Bytes as text: ``strict`` (null where they are not UTF-8), ``ignore`` (what is not UTF-8 is left out) or ``replace``."""
    text = content.cast("string")
    if errors == "strict":
        return F.try_validate_utf8(text)
    if errors == "replace":
        return F.make_valid_utf8(text)

    @F.pandas_udf("string")
    def left_out(held: pd.Series) -> pd.Series:
        return held.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    # Python only where something is to be left out
    faulty = F.when(~F.is_valid_utf8(text), content)
    return F.when(F.is_valid_utf8(text), text).otherwise(left_out(faulty))


def prose(text: Column, kind: str) -> Column:
    """Human-readable text of a file by kind: markdown, markup, json or code."""
    stripped = F.filter(F.transform(F.split(text, "\n", -1), T.strip_u), lambda x: x != "")
    if kind == "markup":
        stripped = F.filter(F.transform(stripped, lambda x: T.strip_u(F.regexp_replace(x, "<[^>]+>", " "))), lambda x: x != "")
    if kind == "json":
        found = F.flatten(F.transform(stripped, lambda x: F.regexp_extract_all(x, F.lit(V.JSON_QUOTED), 1)))
        stripped = F.filter(found, lambda x: ~x.rlike(V.JSON_NAME) & (F.length(x) > 2))
    if kind == "code":
        return _code_prose(F.array_join(stripped, "\n"))
    return F.array_join(stripped, "\n")


def _code_prose(text: Column) -> Column:
    """Comments, docstring lines and lines that are one string, of text whose lines are stripped and not blank.

    A block comment lasts from a line that begins it to a later one that ends it.
    """
    without = lambda x, signs: F.regexp_replace(x, f"^[{signs}]+", "")
    comment = lambda x: F.when(x.rlike("^#(?!!)"), without(x, "# ")).when(x.startswith("//"), without(x, "/ "))

    def in_block(x):
        return comment(x).when(x.startswith("/*"), without(x, "/* ")).when(x.contains("*/"), F.regexp_replace(x, r"[*/ ]+$", "")).otherwise(without(x, "* "))

    def outside(x):
        marked = F.trim(F.regexp_replace(x, "[\"']{3}", ""))
        return comment(x).when(x.rlike("\"{3}|'{3}"), marked).when(x.rlike("^['\"].*['\"]") & (F.length(x) > 4), F.regexp_replace(x, "^['\"]+|['\"]+$", ""))

    def told(part, work):
        return F.filter(F.transform(F.filter(F.split(part, "\n", -1), lambda x: x != ""), work), lambda x: x.isNotNull())

    gaps, blocks = F.split(text, V.COMMENT_BLOCK, -1), F.regexp_extract_all(text, F.lit(V.COMMENT_BLOCK), 0)
    parts = F.zip_with(gaps, blocks, lambda g, b: F.concat(told(F.coalesce(g, F.lit("")), outside), told(F.coalesce(b, F.lit("")), in_block)))
    return F.array_join(F.flatten(parts), "\n")


def file_prose(path: Column, text: Column) -> Column:
    """:func:`prose` by the file's suffix."""
    suffix = T.suffix(path)
    return (
        F.when(suffix.isin(".md", ".markdown", ".rst"), prose(text, "markdown")).when(suffix.isin(V.TAGGED_SUFFIXES), prose(text, "markup"))
        .when(suffix == ".json", prose(text, "json")).otherwise(prose(text, "code"))
    )
