"""Column functions on text: classes of characters, keys, tokens, chunks, paths."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom import fixed_values as V

SEP = "\x1f"


def strip_u(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def has_han(text: Column) -> Column:
    return text.rlike(V.HAN)


def has_broad(text: Column) -> Column:
    return text.rlike(V.BROAD)


def count_broad(text: Column) -> Column:
    return F.regexp_count(text, F.lit(V.BROAD))


def broad_percent(text: Column) -> Column:
    return F.round(count_broad(text) * 100.0 / F.greatest(F.length(text), F.lit(1)), 1)


def translation_key(text: Column, kind: Column, context: Column | None = None) -> Column:
    parts = [text, kind] + ([context] if context is not None else [])
    return F.sha2(F.concat_ws(SEP, *parts), 256)


def segment_id(path: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(SEP, path, start.cast("string"), end.cast("string")), 256), 1, 16)


def tokens(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches as a sorted bag, so that two bags are equal if the arrays are."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(pattern), group))


def code_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(V.CODE_BLOCK), 1)


def protected_split(text: Column) -> tuple[Column, Column]:
    """(gaps, tokens) around protected tokens; there is one gap more than tokens."""
    return F.split(text, V.PROTECTED, -1), F.regexp_extract_all(text, F.lit(V.PROTECTED), 0)


def weave(gaps: Column, found: Column) -> Column:
    """Gaps and tokens put together again."""
    pairs = F.zip_with(gaps, found, lambda g, t: F.concat(F.coalesce(g, F.lit("")), F.coalesce(t, F.lit(""))))
    return F.array_join(pairs, "")


def is_prose(text: Column) -> Column:
    """Whether something is left without protected tokens, inline code and addresses."""
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, V.PROTECTED, ""), V.INLINE_CODE, ""), V.URL, "")
    return strip_u(rest) != ""


def is_plain_value(text: Column) -> Column:
    """Whether a value of structured data is prose rather than a path, an address or an identifier."""
    blank = strip_u(text) == ""
    return ~(blank | text.contains("/") | text.contains("\\") | text.rlike(V.ENUM_LIKE))


def is_machine_constant(text: Column) -> Column:
    return ~has_han(text) & text.rlike(r"(?U)^[\p{Lu}\p{Nd}_]+$")


#: Signs of program code in a line.
CODE_SIGNS = ["{", "}", "()", "=>", ";;", "import ", "def ", "fn ", "func "]


def is_mostly_code(text: Column) -> Column:
    lines = F.split(strip_u(text), "\n", -1)
    coded = F.filter(lines, lambda x: _any_contains(x, CODE_SIGNS))
    return (F.size(lines) > 3) & (F.size(coded) > F.size(lines) * 0.7)


def _any_contains(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def one_line(text: Column) -> Column:
    return F.translate(text, "\r\n", "  ")


def chunks(text: Column, limit: int) -> Column:
    """Lines packed in order into chunks of at most ``limit`` characters, each line with its line feed counted.

    A text within the limit is one chunk, and so is a longer line.
    """
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def add(acc, line):
        fits = F.length(acc["now"]) + F.length(line) + 2 <= limit
        return F.when(acc["now"].isNull(), F.struct(acc["done"].alias("done"), line.alias("now"))).when(
            fits, F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.lit("\n"), line).alias("now"))
        ).otherwise(F.struct(F.array_append(acc["done"], acc["now"]).alias("done"), line.alias("now")))

    packed = F.aggregate(F.split(text, "\n", -1), empty, add, lambda acc: F.array_append(acc["done"], acc["now"]))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def packed(text: str, limit: int) -> list[str]:
    """:func:`chunks` of a plain string."""
    out: list[str] = []
    for line in text.split("\n") if len(text) > limit else [text]:
        if out and len(out[-1]) + len(line) + 2 <= limit:
            out[-1] += "\n" + line
        else:
            out.append(line)
    return out


def merged_lines(original: Column, translated: Column, suffix_: Column) -> Column:
    """The translated text of a document; of other files its lines where the original's hold Chinese, Japanese or Korean
    characters and the translation is not blank, if both have as many lines, else the translated text.
    """
    old, new = F.split(original, "\n", -1), F.split(translated, "\n", -1)
    lines = F.zip_with(old, new, lambda o, t: F.when(has_broad(o) & (strip_u(t) != ""), t).otherwise(o))
    return F.when(~suffix_.isin(V.DOCUMENT_SUFFIXES) & (F.size(old) == F.size(new)), F.array_join(lines, "\n")).otherwise(translated)


def segment_fault() -> Column:
    """Why a row of segment columns breaks the row constraints; null where it does not."""
    return (
        F.when(~F.coalesce((F.col("start_byte") >= 0) & (F.col("start_byte") < F.col("end_byte")), F.lit(False)), "range")
        .when(F.col("path").isNull() | (F.col("path") == "") | F.col("path").rlike(r"^[/\\]") | F.array_contains(F.split("path", r"[/\\]"), ".."), "path")
        .when(~F.coalesce(F.col("kind").isin(V.KINDS), F.lit(False)), "kind")
        .when(~F.coalesce(F.sha2("source_text", 256) == F.col("source_sha256"), F.lit(False)), "digest")
    )


def suffix(path: Column) -> Column:
    """Lower-case suffix of the file name, with its dot; names that only begin with a dot have none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def glob_regex(patterns: Sequence[str]) -> str:
    """One regular expression for shell patterns; ``*`` crosses folders and ``**/`` may stand for nothing."""
    forms = {"**/": "(?:.*/)?", "?": "."}

    def part(m: re.Match) -> str:
        found = m[0]
        if found in forms:
            return forms[found]
        if found.startswith("*"):
            return ".*"
        return found.replace("[!", "[^", 1) if found.startswith("[") and len(found) > 1 else re.escape(found)

    return "^(?s:" + "|".join(re.sub(r"\*\*/|\*+|\?|\[[^\]]+\]|[^*?\[]+|\[", part, p) for p in patterns) + ")$"


def lit_array(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))
