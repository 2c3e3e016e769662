"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``n`` characters may be met with up to ``n * percent // 100`` edits.  It is cut into one piece more
than that, so one piece at least is met exactly: an Aho-Corasick automaton of all pieces finds these hits, and
Myers' bit-parallel distance (one Python integer holds a column) verifies the text around them.

Items are dealt into blocks of about ``ITEM_CHARS`` characters by their hash; one block at a time is in the driver, is sent
to the workers and matched against all whole texts.  Texts and items are compared in lower case with white space as single blanks; ``start`` and ``end`` count characters of that form.

Defined cases: null and blank items match nothing; null and empty texts hold nothing; equal items are reported
under each id; a repeated document is reported for each row; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import discard, per_document, released, staged, worker_tables

PERCENT = 8
#: Characters of items that one pass over the documents takes (bounds what is sent to the workers).
ITEM_CHARS = 2_000_000
SCHEMA = "doc_id long, item_id long, distance long, start long, end long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their offsets."""
    n, out = len(item), []
    for k in range(budget + 1):
        a, b = n * k // (budget + 1), n * (k + 1) // (budget + 1)
        out.append((a, item[a:b]))
    return out


class Myers:
    """Smallest edit distance of a pattern to any stretch of a text, bit-parallel."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def search(self, text: str, budget: int) -> tuple[int, int]:
        """(distance, end) of the best stretch, the first such end; distance is budget + 1 if there is none."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score, best, at = full, 0, self.size, budget + 1, -1
        for j, c in enumerate(text):
            eq = self.masks.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | (full & ~(xh | up))
            mh = up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1 & full, mh << 1 & full
            up = mh | (full & ~(xv | ph))
            down = ph & xv
            if score < best:
                best, at = score, j + 1
        return best, at


class Matcher:
    """All items of a block; one a worker."""

    def __init__(self, items: list[tuple[int, str]], percent: int):
        self.texts = sorted({t for t in (normal(x) for _, x in items) if t})
        number = {t: i for i, t in enumerate(self.texts)}
        self.ids: list[list[int]] = [[] for _ in self.texts]
        for item_id, text in items:
            if normal(text):
                self.ids[number[normal(text)]].append(item_id)
        self.budget = [len(t) * percent // 100 for t in self.texts]
        self.myers: dict[int, Myers] = {}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.texts):
            for offset, piece in pieces(t, self.budget[i]):
                held = self.automaton.get(piece, None)
                if held is None:
                    self.automaton.add_word(piece, held := [])
                held.append((i, offset, len(piece)))
        if self.texts:
            self.automaton.make_automaton()

    def _verify(self, i: int, text: str) -> tuple[int, int]:
        if i not in self.myers:
            self.myers[i] = Myers(self.texts[i])
        return self.myers[i].search(text, self.budget[i])

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, distance, start, end): the best match of every item that the text holds."""
        if not self.texts:
            return
        found: dict[int, tuple[int, int, int]] = {}
        spans: dict[int, list[list[int]]] = {}
        for end, hits in self.automaton.iter(text):
            for i, offset, size in hits:
                begin = end + 1 - size - offset
                lo, hi = begin - self.budget[i], begin + len(self.texts[i]) + self.budget[i]
                own = spans.setdefault(i, [])
                if own and lo <= own[-1][1] and lo >= own[-1][0]:  # hits side by side are verified together
                    own[-1][1] = max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
        for i, own in spans.items():
            for lo, hi in own:
                lo = max(0, lo)
                distance, end = self._verify(i, text[lo:hi])
                if distance <= self.budget[i] and (i not in found or distance < found[i][0]):
                    # the same search backwards from the end gives the start
                    stretch = text[lo : lo + end][::-1]
                    _, back = Myers(self.texts[i][::-1]).search(stretch[: len(self.texts[i]) + distance], distance)
                    found[i] = (distance, lo + end - back, lo + end)
        for i, (distance, start, end) in sorted(found.items()):
            for item_id in self.ids[i]:
                yield item_id, distance, start, end


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Blocks of items, equal texts in one; at least one block, which may be empty."""
    known = items.select("item_id", "text").filter("text is not null")
    count = -(-int(known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // ITEM_CHARS)
    for k in range(max(1, count)):
        block = known.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, count))) == k).toArrow()
        yield list(zip(block["item_id"].to_pylist(), block["text"].to_pylist()))


_matchers: dict = worker_tables(__name__)


def _matcher(sent, percent: int) -> Matcher:
    key = (tuple(sent.value), percent)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(sent.value, percent)
    return _matchers[key]


def leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, distance, start, end of every item in every document."""
    parts: list[DataFrame] = []
    for block in _blocks(items):
        if parts and not hasattr(parts[-1], "staged_path"):
            parts[-1] = staged(parts[-1], "leaks")
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def work(rows, sent=sent):
            matcher = _matcher(sent, percent)
            found = [(i, *hit) for i, t in zip(rows["doc_id"], rows["text"]) for hit in matcher.find(normal(t))]
            return dict(zip((c.split()[0] for c in SCHEMA.split(", ")), zip(*found) if found else [[]] * 5))

        parts.append(per_document(docs, ["doc_id", "text"], SCHEMA, work))
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns stay, nothing is shuffled."""
    held = None  # the staged table that ``docs`` reads
    for number, block in enumerate(_blocks(items)):
        if number:
            before, docs = held, staged(docs, "clean")
            held = docs
            if before is not None:
                discard(before)
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches, sent=sent):
            matcher = _matcher(sent, percent)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                yield batch.filter(pa.array([next(matcher.find(normal(t)), None) is None for t in texts], pa.bool_()))

        docs = docs.mapInArrow(released(keep), docs.schema)
    return docs
