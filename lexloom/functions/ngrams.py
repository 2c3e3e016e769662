"""Language profiles: character n-grams of labelled texts as a table, and naive Bayes scores of whole texts by them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of an n-gram at most, and how many n-grams of each language a profile keeps.
LONGEST, KEPT = 3, 500
#: Distinct n-grams that a task counts before it hands them on, and characters of texts that are looked at together.
HELD, BLOCK = 400_000, 1 << 18
#: Cells of a profile's table from three code points to an n-gram; larger ones are searched instead.
CELLS = 1 << 24
PROFILE_DDL = "lang string, gram string, n long"
_SPACE = 32


_held: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once a worker."""
    if not _held:
        _held.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _held[0]


def grams(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, n-gram) of all places, for n from 1; an n-gram is its code points, 21 bits each.

    Texts are in lower case, a run of other characters than letters is one blank, and so are both ends.
    """
    lowered = [f" {t} " for t in (x.lower() if x else "" for x in texts)]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(lowered)), np.fromiter(map(len, lowered), np.int64, len(lowered)))
    code = np.where(letters()[points], points, _SPACE)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != _SPACE) | (code[:-1] != _SPACE) | (text[1:] != text[:-1])
    code, text = code[keep], text[keep]
    key, first = code, text
    yield first[code != _SPACE], code[code != _SPACE]
    for n in range(2, LONGEST + 1):
        key, first = (key[:-1] << 21) | code[n - 1 :], first[:-1]
        whole = first == text[n - 1 :]
        yield first[whole], key[whole]


def blocks(texts: Sequence[str | None]) -> Iterator[range]:
    """Texts in order, about BLOCK characters together; a longer one is alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > BLOCK:
            yield range(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield range(start, len(texts))


def spelled(key: int) -> str:
    out = ""
    while key:
        out, key = chr(key & 0x1FFFFF) + out, key >> 21
    return out


def key_of(gram: str) -> int:
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def counted(labelled: DataFrame) -> DataFrame:
    """lang, gram and n of all whole texts (text, lang); counted in each task first."""

    def run(batches):
        held: dict[tuple[str, int], int] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist())
            for lang in np.unique(langs):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for block in blocks(own):
                    for _, keys in grams([own[i] for i in block]):
                        for k, n in zip(*(x.tolist() for x in np.unique(keys, return_counts=True))):
                            held[lang, k] = held.get((lang, k), 0) + n
                    if len(held) > HELD:
                        yield _counts(held)
                        held = {}
        yield _counts(held)

    some = labelled.select("text", "lang").filter("text is not null and lang is not null")
    return some.mapInArrow(run, PROFILE_DDL).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _counts(held: dict[tuple[str, int], int]) -> pa.RecordBatch:
    langs, keys = zip(*held) if held else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(map(spelled, keys), pa.string()), pa.array(held.values(), pa.int64())], names=["lang", "gram", "n"])


def train(labelled: DataFrame, kept: int = KEPT) -> DataFrame:
    """The profile of (text, lang) rows: how often each language has each of the n-grams that are among the ``kept`` most
    frequent of any language (ties: in order of the n-gram).  Its size is bounded by the number of languages.
    """
    counts = counted(labelled)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    frequent = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= kept)
    return counts.join(F.broadcast(frequent.select("gram").distinct()), "gram", "left_semi").select("lang", "gram", "n")


@dataclass
class Profile:
    """A profile in memory: n-grams in order, and a row of weights for each: thousandths of log probabilities by language."""

    languages: list[str]
    keys: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, table: DataFrame) -> Profile:
        rows = table.select("lang", "gram", "n").toPandas()
        languages, known = sorted(rows.lang.unique()), np.unique(np.array([key_of(g) for g in rows.gram.unique()], np.int64))
        n = np.zeros((len(known), len(languages)))
        place = {k: i for i, k in enumerate(languages)}
        n[np.searchsorted(known, [key_of(g) for g in rows.gram]), [place[x] for x in rows.lang]] = rows.n
        share = (n + 0.5) / (n.sum(axis=0) + 0.5 * len(known)) if len(known) else n
        return cls(languages, known, np.floor(1000 * np.log(share)).astype(np.int64))

    def __post_init__(self):
        # code points of the n-grams get small numbers, so that three of them are a place in a table
        parts = np.stack([self.keys >> (21 * n) & 0x1FFFFF for n in range(LONGEST)])
        self.points = np.unique(parts[parts > 0])
        self.table = None
        width = len(self.points) + 1
        if width**LONGEST <= CELLS:
            small = np.where(parts > 0, np.searchsorted(self.points, parts) + 1, 0)
            self.table = np.full(width**LONGEST, -1, np.int32)
            self.table[(small[2] * width + small[1]) * width + small[0]] = np.arange(len(self.keys))
            self.number = np.zeros(0x110000, np.int32)
            self.number[self.points] = np.arange(1, width)

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are n-grams of the profile, their places)."""
        if self.table is None:
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return (hit := self.keys[at] == key), at[hit]
        width, at, odd = len(self.points) + 1, np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        for n in reversed(range(LONGEST)):
            point = key >> (21 * n) & 0x1FFFFF
            small = self.number[point]
            odd |= (small == 0) & (point > 0)
            at = at * width + small
        found = self.table[at]
        return (hit := (found >= 0) & ~odd), found[hit]

    def scores(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text (rows) by language (columns), and how many known n-grams each text has."""
        out, met = np.zeros((len(texts), len(self.languages)), np.int64), np.zeros(len(texts), np.int64)
        if not len(self.keys):
            return out, met
        for block in blocks(texts):
            lo, hi = block.start, block.stop
            for text, key in grams([texts[i] for i in block]):
                hit, at = self._find(key)
                text = text[hit]
                met[lo:hi] += np.bincount(text, minlength=hi - lo)
                for k in range(len(self.languages)):
                    out[lo:hi, k] += np.bincount(text, self.weights[at, k], hi - lo).astype(np.int64)
        return out, met

    def best(self, texts: Sequence[str | None]) -> list[str | None]:
        """The language of the highest score (ties: the first in order); none without a known n-gram."""
        scores, met = self.scores(texts)
        return [self.languages[k] if n else None for k, n in zip(scores.argmax(axis=1), met)] if self.languages else [None] * len(texts)
