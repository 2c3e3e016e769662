"""Which files are read, and their lines with byte positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom import fixed_values as V
from lexloom.functions import text as T
from lexloom.functions.arrays import let, running


def should_translate(path: Column, length: Column, include=None, exclude=None, translate_code: bool = True) -> Column:
    """One predicate for folders, lock files, suffixes, minified and hidden files, globs and size."""
    name, suffix = F.element_at(F.split(path, "/"), -1), T.suffix(path)
    ok = ~F.arrays_overlap(F.split(path, "/"), T.lit_array(V.SKIPPED_FOLDERS))
    ok = ok & ~name.isin(V.LOCK_FILES) & ~suffix.isin(V.BINARY_SUFFIXES) & suffix.isin(V.TEXT_SUFFIXES)
    ok = ok & ~name.rlike(r"\.(min|bundle)\.(js|css)$") & ~name.startswith(".") & (length <= V.MAX_FILE_BYTES)
    if not translate_code:
        ok = ok & suffix.isin(V.DOCUMENT_SUFFIXES)
    if include:
        ok = ok & path.rlike(T.glob_regex(include))
    if exclude:
        ok = ok & ~path.rlike(T.glob_regex(exclude))
    return ok


def needs_translation(text: Column, lang: Column) -> Column:
    """Sources in Chinese, Japanese or Korean need such characters, others some text."""
    return F.when(lang.isin("zh", "ja", "ko"), T.has_broad(text)).otherwise(F.length(T.strip_u(text)) > 20)


def enough(prose: Column) -> Column:
    """Whether a file's prose is long enough to be translated at all."""
    return F.length(T.strip_u(prose)) >= 5


def is_binary(content: Column) -> Column:
    """A zero byte among the first 4096, or not UTF-8."""
    return F.hex(F.substring(content, 1, 4096)).rlike("^(?:..)*?00") | ~F.is_valid_utf8(content.cast("string"))


def lines(files: DataFrame, text: str = "src", where: Callable[[Column], Column] | None = None) -> DataFrame:
    """ln (from 0), line and start_byte of every line (``where`` a condition on the line holds), beside the other columns of ``files``.

    Files are cut at line feeds only.  Column functions within each file's row: nothing is shuffled, and the text itself does not
    travel with its lines.
    """
    kept = [f"`{c}`" for c in files.columns if c != text]
    row = lambda line, k, starts: F.struct(k.alias("ln"), line.alias("line"), F.get(starts, k).alias("start_byte"))

    def told(all_: Column) -> Column:
        starts = running(F.transform(all_, lambda x: (F.octet_length(x) + 1).cast("long")))
        rows = let(starts, lambda at: F.transform(all_, lambda x, k: row(x, k, at)))
        return rows if where is None else F.filter(rows, lambda r: where(r["line"]))

    return files.select(*kept, F.inline(let(F.split(f"`{text}`", "\n", -1), told)))


def resume(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that are new or changed since the last run."""
    return files.join(done.select("path", "file_sha256"), ["path", "file_sha256"], "left_anti")


def head_sample(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy("path").limit(n)


def hash_sample(files: DataFrame, rate: float, most: int, seed: int = 0) -> DataFrame:
    """A repeatable random sample: at least one file, at most ``most``."""
    n = files.count()
    return files.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), "path"), 256), "path").limit(min(max(1, int(n * rate)), most, n))
