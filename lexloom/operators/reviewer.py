"""Reviews by a model that is plugged in: pairs of files in, issues out; one that fails or talks nonsense gives none."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators import scan, verify
from lexloom.operators.translate import Http, Pace

#: Characters of a file that a model is shown, and those below which it is not asked.
SHOWN, LEAST = 3000, 50


class Reviewer(Protocol):
    """Issues of one pair, each with ``type``, ``severity`` and ``message``.  Must be safe to repeat (tasks are retried)."""

    def review(self, path: str, source: str, target: str) -> Sequence[dict]: ...


class Silent:
    """The offline reviewer: finds nothing."""

    def review(self, path: str, source: str, target: str) -> list[dict]:
        return []


class Chat:
    """A service with the chat completions format that answers in JSON: {"issues": [...]}."""

    def __init__(self, url: str, key: str, model: str, timeout: float = 60.0, pause: float = 1.0):
        self.url, self.key, self.model, self.timeout, self.pace = url, key, model, timeout, Pace(pause)

    def review(self, path: str, source: str, target: str) -> list[dict]:
        ask = f"Compare a file with its translation. Answer with JSON: an object with a list issues of objects with type, severity and message.\n\nFile {path}\n\nSource:\n{source}\n\nTranslation:\n{target}"
        encode = lambda _: {"model": self.model, "temperature": 0.1, "response_format": {"type": "json_object"}, "messages": [{"role": "user", "content": ask}]}
        decode = lambda answer: json.loads(answer["choices"][0]["message"]["content"])["issues"]
        return Http(f"{self.url.rstrip('/')}/chat/completions", encode, decode, {"Authorization": f"Bearer {self.key}"}, 1, self.pace, self.timeout).translate([path])


def shortened(text: Column, limit: int = SHOWN) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def review_pairs(pairs: DataFrame, reviewer: Reviewer, prefix: str = "ai_") -> DataFrame:
    """Issues of pairs (path, a, b) by a reviewer, their types with ``prefix``; short files are left out."""
    names = ["file", "issue_type", "severity", "message", "source", "target"]
    asked = pairs.filter((F.length("a") >= LEAST) & (F.length("b") >= LEAST)).select("path", shortened(F.col("a")).alias("a"), shortened(F.col("b")).alias("b"))

    def run(batches):
        for batch in batches:
            out = []
            for path, a, b in zip(*(batch.column(c).to_pylist() for c in ("path", "a", "b"))):
                try:
                    found = [(path, prefix + str(i["type"]), str(i["severity"]), str(i["message"])[:200], None, None) for i in reviewer.review(path, a, b)]
                except Exception:
                    found = []
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 6)], names=names)

    return asked.mapInArrow(run, verify.ISSUE)


def _plain_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    return verify.pairs_of(source, target).filter(~F.col("binary"))


def sampled(source: DataFrame, target: DataFrame, rate: float = 0.15, most: int = 20) -> int:
    """How many files :func:`equivalence` selects."""
    n = _plain_pairs(source, target).count() if rate > 0 else 0
    return min(max(1, int(n * rate)), most, n) if n else 0


def equivalence(source: DataFrame, target: DataFrame, reviewer: Reviewer, rate: float = 0.15, most: int = 20) -> DataFrame:
    """Issues by a reviewer of the first files of both trees, in order of path; a rate of 0 asks for none."""
    some = scan.head_sample(_plain_pairs(source, target), sampled(source, target, rate, most))
    return review_pairs(some.select("path", F.col("c1").cast("string").alias("a"), F.col("c2").cast("string").alias("b")), reviewer)


def review(translated: DataFrame, original: DataFrame | None = None, reviewer: Reviewer | None = None, rate: float = 0.15, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(issues, score) of a random sample of files (path, content): checks by rule, and by the reviewer where there is an original."""
    files = translated.filter(F.is_valid_utf8(F.col("content").cast("string")))
    sample = scan.hash_sample(files, rate, most).select("path", F.decode("content", "UTF-8").alias("src"))
    none = F.lit(None).cast("string")
    issues = verify.review(sample).select("file", "line", "issue_type", "severity", none.alias("message"))
    if original is not None and reviewer is not None:
        both = sample.join(original.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("a")), "path", "left")
        told = review_pairs(both.filter("a is not null").select("path", "a", F.col("src").alias("b")), reviewer, "")
        issues = issues.unionByName(told.select("file", F.lit(0).alias("line"), "issue_type", "severity", "message"))
    return issues, verify.score(issues)
