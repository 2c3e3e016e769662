"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton.  A text is cut greedily into the longest phrases that
occur in a language's text; the language that needs the fewest phrases a symbol wins.  All texts of a block
and all languages are lanes of one numpy array.  A long text is parsed in stretches of ``STRETCH`` symbols side by side,
each from the state that the symbols before it lead to; where the stretch before ends in another state, it is parsed again
from that one, so the phrases are those of the whole text.

The automata are learned from a bounded sample of labelled rows: of each language the first of about ``SAMPLE_DOCS`` by hash, each
with its whole text, as many as have ``LANGUAGE_CHARS`` characters together; texts beyond that bound are passed over, unless a language has
no other, when its shortest is taken.  What is learned of a language does not depend on the others, so memory and time grow
with their number.  All labelled languages are learned, and every letter of their samples is a symbol.  Transitions are a dense table where the language's alphabet is
small, else a hashed one.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is everything if no row is
labelled; ties go to the language that sorts first; repeated rows are predicted row by row; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import per_document, worker_tables

SAMPLE_DOCS, LANGUAGE_CHARS = 400, 80_000
#: Cells of a language's dense transition table; larger ones are hashed.
DENSE = 1 << 23
#: Symbols of a stretch, and of those before it that tell its first state.
STRETCH, WARM = 512, 64
#: Phrases that make a language about e times less likely, for the score.
SHARPNESS = 2.0
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def is_held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1 if doc_id is not None else False


class SuffixAutomaton:
    """Transitions of the smallest automaton of all substrings of a sequence of small integers (0 ends a passage)."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        last = 0
        for s in symbols:
            if s == 0:  # no phrase spans two passages
                last = 0
                continue
            last = self._extend(last, s)

    def _state(self, edges: dict[int, int], link: int, longest: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.next) - 1

    def _split(self, p: int, q: int, s: int) -> int:
        clone = self._state(dict(self.next[q]), self.link[q], self.longest[p] + 1)
        while p >= 0 and self.next[p].get(s) == q:
            self.next[p][s] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, s: int) -> int:
        q = self.next[last].get(s)
        if q is not None:  # happens after a passage has ended
            return q if self.longest[q] == self.longest[last] + 1 else self._split(last, q, s)
        new = self._state({}, 0, self.longest[last] + 1)
        p = last
        while p >= 0 and s not in self.next[p]:
            self.next[p][s] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][s]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, q, s)
        return new


def letters(text: str) -> str:
    """Lower case; all else than letters becomes blanks."""
    text = text.lower()
    return text if text.isalpha() else "".join(c if c.isalpha() else " " for c in text)


class Transitions:
    """Ways of one automaton: ``next state << 2 | phrases ended`` of arrays of states and symbols.

    No way on: the phrase ends and the symbol begins the next one; one that no text has is a phrase.
    """

    def __init__(self, edges: list[dict[int, int]], width: int):
        self.width, n = width, len(edges)
        state = np.repeat(np.arange(n), [len(e) for e in edges])
        symbol = np.fromiter((s for e in edges for s in e), np.int64, len(state))
        to = np.fromiter((t for e in edges for t in e.values()), np.int64, len(state))
        begin = np.zeros(width, np.int64)
        begin[symbol[state == 0]] = to[state == 0]
        stuck = begin << 2 | 1 + (begin == 0)
        root = begin << 2 | (begin == 0)
        self.stuck = stuck.astype(np.int32)
        self.keys = None
        if n * width <= DENSE:
            table = np.tile(self.stuck, (n, 1))
            table[0] = root
            table[state, symbol] = to << 2
            self.table = table.ravel()
            return
        # the root's row is held in full, so that a symbol it lacks is found there
        key = np.concatenate([np.arange(width), (state * width + symbol)[state > 0]])
        value = np.concatenate([root, to[state > 0] << 2])
        self.mask = (1 << (2 * len(key) - 1).bit_length()) - 1
        self.keys, self.table = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        at, left = self._slot(key), np.arange(len(key))
        while left.size:
            free = self.keys[at] < 0
            self.keys[at[free]] = key[left[free]]  # of several, one stays
            placed = self.keys[at] == key[left]
            self.table[at[placed]] = value[left[placed]]
            at, left = (at[~placed] + 1) & self.mask, left[~placed]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) & self.mask

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + symbol
        if self.keys is None:
            return self.table[key]
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.table[at], self.stuck[symbol])
        other = np.flatnonzero((found != key) & (found >= 0))
        at = at[other]
        while other.size:
            at = (at + 1) & self.mask
            held = self.keys[at]
            hit = held == key[other]
            out[other[hit]] = self.table[at[hit]]
            more = ~hit & (held >= 0)
            at, other = at[more], other[more]
        return out


def _parse(step: Transitions, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last state of each lane, from ``state``, and the phrases that ended in it."""
    order = np.argsort(-size, kind="stable")
    start, length, now = begin[order], size[order], state[order]
    count = np.zeros(len(order), np.int32)
    live = len(length) - np.searchsorted(length[::-1], np.arange(length[0] if len(length) else 0), side="right")
    for k, n in enumerate(live.tolist()):
        got = step(now[:n], symbols[start[:n] + k])
        count[:n] += got & 3
        now[:n] = got >> 2
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return now[back], count[back]


class Identifier:
    """Automata of all languages; made once a worker from the sampled texts."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        seen = sorted({c for passages in samples.values() for p in passages for c in letters(p)} - {" "})
        # 0: a letter that no sample has, 1: no letter
        self.code = np.fromiter((not chr(i).isalpha() for i in range(0x110000)), np.int32, 0x110000)
        self.code[list(map(ord, seen))] = np.arange(2, 2 + len(seen))
        self.own, self.steps = [], []
        for name in self.names:
            codes = [self.symbols([p])[0] for p in samples[name]]
            # symbols of the language itself: 0 for all letters that it lacks
            used = np.unique(np.concatenate([[1], *codes]))
            used = used[used > 0]
            own = np.zeros(2 + len(seen), np.int32)
            own[used] = np.arange(1, 1 + len(used))
            made = SuffixAutomaton([s for c in codes for s in [*own[c].tolist(), 0]])
            self.own.append(own)
            self.steps.append(Transitions(made.next, 1 + len(used)))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts (one blank for a run of others than letters), and how many each text has."""
        lowered = [t.lower() for t in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
        codes = self.code[points]
        text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), np.int64, len(texts)))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1) | (text[1:] != text[:-1])
        return codes[keep], np.bincount(text[keep], minlength=len(texts))

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        codes, sizes = self.symbols(texts)
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        begin = np.repeat(np.cumsum(sizes) - sizes, pieces) + STRETCH * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.minimum(STRETCH, np.repeat(np.cumsum(sizes), pieces) - begin)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        final = np.flatnonzero(np.append(owner[1:] != owner[:-1], [True] * bool(len(owner))))
        out = np.zeros((len(texts), len(self.names)), np.int64)
        for column, (own, step) in enumerate(zip(self.own, self.steps)):
            mine = own[codes]
            entry = np.zeros(len(size), np.int32)
            entry[inner] = _parse(step, mine, begin[inner] - WARM, np.full(len(inner), WARM, np.int64), entry[inner])[0]
            state, count = _parse(step, mine, begin, size, entry)
            wrong = inner[entry[inner] != state[inner - 1]]
            while wrong.size:  # the first of a text is right afterwards, and so are all that follow from it
                entry[wrong] = state[wrong - 1]
                state[wrong], count[wrong] = _parse(step, mine, begin[wrong], size[wrong], entry[wrong])
                wrong = inner[entry[inner] != state[inner - 1]]
            count[final] += state[final] != 0
            out[:, column] = np.bincount(owner, count, len(texts))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        count = self.phrases(texts)
        best = count.argmin(axis=1)
        odds = np.exp(np.maximum((count.min(axis=1, keepdims=True) - count) / SHARPNESS, -700.0)).sum(axis=1)
        told = [any(map(str.isalpha, t)) for t in texts]
        return [self.names[b] if ok else "und" for b, ok in zip(best, told)], np.where(told, 1 / odds, 0.0)


def learn(docs: DataFrame) -> dict[str, list[str]]:
    """Sampled texts of each language, from labelled rows that are not held out."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    labelled = docs.select("doc_id", "text", "lang").filter((F.coalesce(crc, F.lit(0)) % 3 != 1) & F.col("lang").isNotNull() & (F.col("text") != ""))
    labelled = labelled.select("lang", "text", F.length("text").alias("chars"), F.xxhash64("doc_id", "text", F.lit("language sample")).alias("place"))
    sizes = labelled.groupBy("lang").agg(F.count_if(F.col("chars") <= LANGUAGE_CHARS).cast("double").alias("size"), F.min("chars").alias("least"))
    bound = F.greatest("least", F.lit(LANGUAGE_CHARS))
    share = F.lit(float(SAMPLE_DOCS)) * F.lit(2.0**64) / F.greatest("size", F.lit(1.0)) - F.lit(2.0**63)
    picked = labelled.join(F.broadcast(sizes), "lang").filter((F.col("chars") <= bound) & (F.col("place").cast("double") <= share))
    upto = Window.partitionBy("lang").orderBy("place", "text").rowsBetween(Window.unboundedPreceding, 0)
    kept = picked.select("lang", "text", "chars", "place", bound.alias("bound")).distinct().withColumn("held", F.sum("chars").over(upto)).filter("held <= bound")
    out: dict[str, list[str]] = {}
    for r in sorted(kept.select("lang", "place", "text").collect()):
        out.setdefault(r.lang, []).append(r.text)
    return {k: v for k, v in out.items() if any(c.isalpha() for p in v for c in p)}


_made: dict[tuple, Identifier] = worker_tables(__name__)


def identify(docs: DataFrame, samples: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``; learned from them unless samples are given."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs) if samples is None else samples)

    def work(rows):
        key = tuple((k, *v) for k, v in sorted(sent.value.items()))
        if key not in _made:
            _made.clear()
            _made[key] = Identifier(sent.value)
        names, scores = _made[key].predict(rows["text"])
        return {"doc_id": rows["doc_id"], "held_out": [is_held_out(i) for i in rows["doc_id"]], "lang_pred": names, "score": scores}

    return per_document(docs, ["doc_id", "text"], SCHEMA, work)
