"""Audit, verification and review of translated trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom import fixed_values as V
from lexloom.functions import text as T
from lexloom.operators import scan
from lexloom.operators.parsers import syntax_errors

ISSUE = "file string, issue_type string, severity string, message string, source string, target string"
#: What Python's splitlines takes as the end of a line.
LINE_ENDS = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def audit(files: DataFrame, text: str = "src") -> DataFrame:
    """path, line and snippet of every line with Han characters."""
    cut = files.filter(T.has_han(F.col(text))).select("path", F.posexplode(F.split(text, LINE_ENDS, -1)).alias("ln", "l"))
    return cut.filter(T.has_han(F.col("l"))).select("path", (F.col("ln") + 1).alias("line"), F.left(T.strip_u(F.col("l")), F.lit(200)).alias("snippet"))


def rank(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in V.SEVERITY.items() for x in kv]), severity), F.lit(0))


def _issue(kind: str, severity: str, source: Column | None = None, target: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.col("path").alias("file"), F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), F.lit(kind.replace("_", " ")).alias("message"), (source if source is not None else none).alias("source"), (target if target is not None else none).alias("target"))


_LOCAL = "[A-Za-z0-9._%+-]"
#: Bags of tokens that both versions of a file must share: signs of which a text with such tokens has one, the pattern, the group.
#: The patterns match what those of ``fixed_values`` match; an address is tried only where a run of its signs begins or the last match has
#: ended, a placeholder only at its first sign.
_BAGS = {
    "url_changed": (("http",), V.URL, 0),
    "email_changed": (("@",), rf"(?:\G|(?<!{_LOCAL})){V.EMAIL.replace('+@', '++@', 1)}", 0),
    "placeholder_changed": (("{", "%", "$"), f"(?=[{{%$])(?:{V.PLACEHOLDER})", 0),
    "inline_code_changed": (("`",), V.INLINE_CODE, 1),
}


def _bag(side: str, kind: str) -> Column:
    """The tokens of one side; texts without their signs are not searched."""
    signs, pattern, group = _BAGS[kind]
    some = F.lit(False)
    for sign in signs:
        some = some | F.contains(F.col(side), F.lit(sign))
    return F.when(some, T.tokens(F.col(side), pattern, group)).otherwise(F.array().cast("array<string>"))


def token_issues(pairs: DataFrame) -> DataFrame:
    """Issues of file pairs (path, a, b): addresses, placeholders and inline code as bags, code blocks in order.

    Pairs that are equal have none and are passed over; each bag is taken once, in a column of its own, and then compared and told.
    """
    fence = lambda side: F.when(F.contains(F.col(side), F.lit("```")), T.code_blocks(F.col(side))).otherwise(F.array().cast("array<string>"))
    bags = [_bag(side, kind).alias(f"{kind}_{side}") for kind in _BAGS for side in "ab"]
    taken = pairs.filter(F.col("a") != F.col("b")).select("path", T.suffix(F.col("path")).isin(".md", ".markdown", ".rst").alias("marked"), *bags, (fence("a") != fence("b")).alias("blocks"))
    told = lambda bag: F.slice(bag, 1, 10).cast("string")
    found = [F.when(F.col("marked") & F.col("blocks"), _issue("code_block_changed", "error"))]
    for kind in _BAGS:
        a, b = F.col(f"{kind}_a"), F.col(f"{kind}_b")
        differ = (a != b) & F.col("marked") if kind == "inline_code_changed" else a != b
        found.append(F.when(differ, _issue(kind, "error", told(a), told(b))))
    return taken.select(F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def kept(files: DataFrame) -> DataFrame:
    """The files that a verification looks at: no skipped folder, not the state of a run."""
    parts = F.split("path", "/")
    return files.filter(~F.arrays_overlap(parts, T.lit_array(V.VERIFY_SKIPPED_FOLDERS)) & (F.element_at(parts, -1) != V.STATE_FILE))


def presence(source: DataFrame, target: DataFrame) -> DataFrame:
    """Files that only one tree has, and links that changed: one full outer join on path that carries no contents."""
    side = lambda df, k: kept(df).select("path", F.col("is_symlink").alias(f"l{k}"), F.col("link_target").alias(f"t{k}"), F.lit(True).alias(f"in{k}"))
    both = side(source, 1).join(side(target, 2), "path", "full_outer")
    link = F.col("in1").isNotNull() & F.col("in2").isNotNull() & (F.col("l1") | F.col("l2"))
    checks = [
        (F.col("in2").isNull(), _issue("missing_file", "error")),
        (F.col("in1").isNull(), _issue("extra_file", "warning")),
        (link & ~((F.col("l1") == F.col("l2")) & F.col("t1").eqNullSafe(F.col("t2"))), _issue("symlink_changed", "error")),
    ]
    return both.select(F.inline(F.filter(F.array(*[F.when(c, i) for c, i in checks]), lambda x: x.isNotNull())))


def pairs_of(source: DataFrame, target: DataFrame) -> DataFrame:
    """path, c1, c2 and binary of the regular files that both trees have."""
    side = lambda df, k: kept(df).filter(~F.col("is_symlink")).select("path", F.col("content").alias(f"c{k}"))
    return side(source, 1).join(side(target, 2), "path").withColumn("binary", scan.is_binary(F.col("c1")) | scan.is_binary(F.col("c2")))


def verify(source: DataFrame, target: DataFrame, syntax: bool = True, contents: bool = True) -> DataFrame:
    """Issues between two trees (path, content, is_symlink, link_target).

    Links are compared as links only, binary files by digest only, other files by syntax and tokens; without
    ``contents`` only what :func:`presence` sees.
    """
    issues = presence(source, target)
    if not contents:
        return issues
    pairs = pairs_of(source, target)
    changed = pairs.filter(F.col("binary") & (F.sha2("c1", 256) != F.sha2("c2", 256)))
    plain = pairs.filter(~F.col("binary"))
    texts = plain.select("path", F.col("c1").cast("string").alias("a"), F.col("c2").cast("string").alias("b"))
    issues = issues.unionByName(changed.select(_issue("binary_changed", "error").alias("i")).select("i.*")).unionByName(token_issues(texts))
    if syntax:
        judged = syntax_errors(plain.filter(T.suffix(F.col("path")).isin(V.SYNTAX_SUFFIXES)), ("c1", "c2"))
        none = F.lit(None).cast("string")
        broken = judged.filter("error_c1 is null and error_c2 is not null")
        issues = issues.unionByName(broken.select(F.col("path").alias("file"), F.lit("syntax_error").alias("issue_type"), F.lit("error").alias("severity"), F.left("error_c2", F.lit(100)).alias("message"), none.alias("source"), none.alias("target")))
    return issues


def by_type(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type").agg(F.count("*").alias("n"))


def worst(issues: DataFrame) -> DataFrame:
    top = F.max_by("severity", rank(F.col("severity")))
    return issues.agg(F.coalesce(top, F.lit("none")).alias("worst_severity"), F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("has_errors"))


def should_fail(issues: DataFrame, threshold: str) -> DataFrame:
    if threshold == "never":
        return issues.agg(F.lit(False).alias("fail"))
    return issues.agg(F.coalesce(F.max(rank(F.col("severity"))) >= V.SEVERITY[threshold], F.lit(False)).alias("fail"))


def top_per_type(issues: DataFrame, n: int = 3) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("issue_type").orderBy("file"))
    return issues.withColumn("place", order).filter(F.col("place") <= n)


def review(files: DataFrame, text: str = "src") -> DataFrame:
    """Lines with more than three characters of the source language, and unclosed code blocks."""
    cut = files.select("path", F.posexplode(F.split(text, "\n", -1)).alias("ln", "l"))
    left = cut.filter(T.count_broad(F.col("l")) > 3).select(F.col("path").alias("file"), (F.col("ln") + 1).alias("line"), F.lit("untranslated").alias("issue_type"), F.lit("error").alias("severity"))
    odd = files.filter((T.suffix(F.col("path")) == ".md") & (F.regexp_count(text, F.lit("```")) % 2 == 1))
    return left.unionByName(odd.select(F.col("path").alias("file"), F.lit(0).alias("line"), F.lit("broken_format").alias("issue_type"), F.lit("warning").alias("severity")))


def score(review_issues: DataFrame) -> DataFrame:
    """100 less the penalties, not below 0."""
    penalty = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in V.PENALTY.items() for x in kv]), F.col("severity")), F.lit(1.0))
    total = F.coalesce(F.sum(penalty), F.lit(0.0))
    return review_issues.agg(F.greatest(F.lit(0.0), 100.0 - total).alias("score"), total.alias("penalty"), F.count("*").alias("issues"))
