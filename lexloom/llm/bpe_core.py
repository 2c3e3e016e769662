"""Byte-pair encoding as a lazily determinised finite-state machine, run over many words at once.

The encoding of a prefix ends in one last token only.  A token ``t`` that ends at position ``i`` and
begins at ``j`` is that last token exactly if ``t`` may stand beside the last token of prefix ``j``
(*pair compatibility*: encoding both together gives the two tokens back).  What the rest of a word can
see of a prefix is therefore the chain of suffixes that still begin some vocabulary entry, each with its
vocabulary-automaton node, the last token before it, and how many tokens fewer it had.  That chain is a
state; states are interned when first met, and each transition carries the new last token and the change
of the token count.  Words are lanes of numpy arrays that step through one hashed transition table.

A long word is cut into pieces that are lanes side by side.  Each piece is a map from an entry state to an exit state
and a count; it is taken at the state that the symbols just before it lead to, and the maps compose in a prefix scan.
Where a piece's exit is not the next one's entry, the next one is run again from the right state.

The table holds a bounded number of transitions: when it is full, the states that lanes are in are interned anew in
an empty one.
"""

from __future__ import annotations

import json
import struct

import numpy as np

#: Transitions kept before the machine is emptied and compiled anew; bounds a worker's memory.
MAX_TRANSITIONS = 1 << 19
#: Lanes that step at once; each may add a transition, so a table never has more than both together.
LANES = 1 << 17
_SLOTS = 1 << 20
#: Symbols of a piece of a long word, and of those before it that tell its entry state.
PIECE, WARM = 512, 48
#: A suffix of a state's chain: node, last token before it, how many tokens fewer.
_SUFFIX = struct.Struct("<iih")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 20)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies, from the rule that all of them follow."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in keep}
    extra = 256
    for b in range(256):
        if b not in keep:
            table[chr(extra)] = b
            extra += 1
    return table


class Vocabulary:
    """Tokens as symbol tuples: a byte, or 256 + byte where a word-end mark is part of the symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_alphabet()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text: dict[int, str] = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.symbols: dict[int, tuple[int, ...]] = {}
        by_text = {}
        for text, i in model["vocab"].items():
            if text in self.special:
                continue
            ends = bool(self.suffix) and text.endswith(self.suffix)
            body = text[: -len(self.suffix)] if ends else text
            if not body or any(c not in letters for c in body):
                continue
            parts = [letters[c] for c in body]
            if ends:
                parts[-1] += 256
            self.symbols[i] = tuple(parts)
            by_text[text] = i
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            if a in by_text and b in by_text and a + b in by_text:
                self.rank[by_text[a], by_text[b]] = (r, by_text[a + b])
        self.single = {s[0]: i for i, s in self.symbols.items() if len(s) == 1}
        #: Vocabulary automaton: one dict of symbol -> node a node, and the token that ends in each node.
        self.edges: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for i, symbols in self.symbols.items():
            node = 0
            for s in symbols:
                step = self.edges[node].get(s)
                if step is None:
                    step = self.edges[node][s] = len(self.edges)
                    self.edges.append({})
                    self.token.append(-1)
                node = step
            self.token[node] = i
        self._pairs: dict[int, bool] = {}

    def merge(self, symbols: tuple[int, ...]) -> list[int]:
        """Plain merging by rank, for pair tests only."""
        parts = [self.single[s] for s in symbols]
        while len(parts) > 1:
            best = min((self.rank[p] + (k,) for k, p in enumerate(zip(parts, parts[1:])) if p in self.rank), default=None, key=lambda x: (x[0], x[2]))
            if best is None:
                break
            parts[best[2] : best[2] + 2] = [best[1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` stays whole beside ``left`` (-1: the word's start)."""
        pair = left + 1 << 32 | right
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) > 400_000:
                self._pairs.clear()
            whole = [left, right] if left >= 0 else [right]
            known = self.merge((self.symbols[left] if left >= 0 else ()) + self.symbols[right]) == whole
            self._pairs[pair] = known
        return known


class Machine:
    """The lazily determinised transducer of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        size = max(vocabulary.symbols) + 1
        self.length = np.ones(size, np.int64)
        for i, s in vocabulary.symbols.items():
            self.length[i] = len(s)
        self._reset()

    def _reset(self, *live: np.ndarray) -> None:
        """Empties the table; the states in ``live`` arrays get their new numbers there."""
        held = [self.states[i] for i in np.unique(np.concatenate(live))] if live else []
        old = self.ids if live else {}
        self.keys = np.full(_SLOTS, -1, np.int64)
        self.values = np.zeros(_SLOTS, np.int64)
        self.filled, self.single = 0, {}
        self.states: list[bytes] = [_SUFFIX.pack(0, -1, 0)]
        self.ids = {self.states[0]: 0}
        if held:
            number = np.zeros(max(old[c] for c in held) + 1, np.int64)
            for chain in held:
                number[old[chain]] = self._intern(chain)
            for array in live:
                array[:] = number[array]

    def _intern(self, chain: bytes) -> int:
        to = self.ids.get(chain)
        if to is None:
            to = self.ids[chain] = len(self.states)
            self.states.append(chain)
        return to

    def _compile(self, key: int) -> int:
        """next state << 24 | last token << 6 | change of the count + 32."""
        state, symbol = key >> 9, key & 511
        v, found, rest = self.vocabulary, None, []
        for node, last, fewer in _SUFFIX.iter_unpack(self.states[state]):
            step = v.edges[node].get(symbol)
            if step is None:
                continue
            token = v.token[step]
            if found is None and token >= 0 and v.compatible(last, token):
                found = (token, fewer + 1)
            if v.edges[step]:
                rest.append((step, last, fewer))
        if found is None:
            raise ValueError(f"no token covers symbol {symbol}")
        token, delta = found
        if not -32 <= delta < 32 or token >= 1 << 18:
            raise ValueError(f"a change of {delta} tokens to {token} does not fit its place")
        chain = b"".join(_SUFFIX.pack(n, t, c - delta) for n, t, c in [*rest, (0, token, delta)])
        return self._intern(chain) << 24 | token << 6 | delta + 32

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MULT) >> _SHIFT).view(np.int64)

    def _add(self, keys: list[int]) -> None:
        for key in keys:
            value = self._compile(key)
            at = int(self._slot(np.array([key], np.int64))[0])
            while self.keys[at] != -1:
                at = (at + 1) % _SLOTS
            self.keys[at], self.values[at] = key, value
        self.filled += len(keys)

    def _step(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        held = self.keys[at]
        out = self.values[at]
        todo = np.flatnonzero(held != keys)
        while todo.size:
            here, want = at[todo], keys[todo]
            held = self.keys[here]
            empty = held == -1
            if empty.any():
                self._add(np.unique(want[empty]).tolist())
                held = self.keys[here]
            hit = held == want
            out[todo[hit]] = self.values[here[hit]]
            todo = todo[~hit]
            at[todo] = (at[todo] + 1) % _SLOTS
        return out

    def _lanes(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray, last: np.ndarray | None, *others: np.ndarray) -> np.ndarray:
        """Steps all lanes to their ends, in ``state``; gives the change of their counts.

        Lanes are ordered by length, so that each step works on one leading slice; ``others`` are states to keep valid.
        """
        count = np.zeros(len(start), np.int64)
        longest = int(length[0]) if len(length) else 0
        # active[k]: how many lanes are longer than k
        active = len(length) - np.searchsorted(length[::-1], np.arange(longest), side="right")
        for k in range(longest):
            m = int(active[k])
            for a in range(0, m, LANES):
                b = min(m, a + LANES)
                if self.filled > MAX_TRANSITIONS:
                    self._reset(state, *others)
                at = start[a:b] + k
                got = self._step(state[a:b] << 9 | symbols[at])
                state[a:b] = got >> 24
                count[a:b] += (got & 63) - 32
                if last is not None:
                    last[at] = got >> 6 & 0x3FFFF
        return count

    def _again(self, symbols: np.ndarray, start: int, length: int, state: int, last: np.ndarray | None) -> tuple[int, int]:
        """Exit state and count of one piece from another entry state."""
        count = 0
        for at in range(start, start + length):
            key = state << 9 | int(symbols[at])
            got = self.single.get(key)
            if got is None:
                got = self.single[key] = int(self._step(np.array([key], np.int64))[0])
            state = got >> 24
            count += (got & 63) - 32
            if last is not None:
                last[at] = got >> 6 & 0x3FFFF
        return state, count

    def _joined(self, symbols, start, length, word, entry, exit_, count, last) -> np.ndarray:
        """Counts of words from the maps of their pieces (in order): where entries fit, sums of them; else piece by piece."""
        fits = np.ones(len(word), bool)
        fits[1:] = (word[1:] != word[:-1]) | (exit_[:-1] == entry[1:])
        wrong = np.unique(word[~fits])
        for w in wrong.tolist():
            rows = np.flatnonzero(word == w)
            state = np.array([exit_[rows[0]]], np.int64)
            for r in rows[1:].tolist():
                if entry[r] != state[0]:
                    if self.filled > MAX_TRANSITIONS:
                        self._reset(state, entry, exit_)
                    exit_[r], count[r] = self._again(symbols, int(start[r]), int(length[r]), int(state[0]), last)
                state[0] = exit_[r]
        return np.bincount(word, count).astype(np.int64)

    def run(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keep: bool):
        """Token counts of the words at ``starts``; with ``keep`` also the last token of every prefix."""
        if self.filled > MAX_TRANSITIONS:
            self._reset()
        pieces = np.where(lengths > 2 * PIECE, -(-lengths // PIECE), 1)
        word = np.repeat(np.arange(len(starts)), pieces)
        number = np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, length = starts[word] + number * PIECE, np.where(pieces[word] > 1, PIECE, lengths[word])
        ends = np.cumsum(pieces) - 1
        length[ends] = lengths - (pieces - 1) * PIECE
        entry = np.zeros(len(word), np.int64)
        inner = np.flatnonzero(number)
        if inner.size:
            warm = np.zeros(len(inner), np.int64)
            self._lanes(symbols, start[inner] - WARM, np.full(len(inner), WARM, np.int64), warm, None)
            entry[inner] = warm
        last = np.zeros(len(symbols), np.int32) if keep else None
        order = np.argsort(-length, kind="stable")
        entry = entry[order]
        state = entry.copy()
        count = self._lanes(symbols, start[order], length[order], state, last, entry)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        if not inner.size:
            return count[back], last
        return self._joined(symbols, start, length, word, entry[back], state[back], count[back], last), last

    def follow(self, last: np.ndarray, starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of all words in order, by the back-pointers from each word's end."""
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        position, slot, begin = starts + lengths, ends - 1, starts
        while position.size:
            token = last[position - 1]
            ids[slot] = token
            position, slot = position - self.length[token], slot - 1
            live = position > begin
            position, slot, begin = position[live], slot[live], begin[live]
        return ids
