"""Pre-tokens by a small transducer whose chunk state maps compose in a parallel prefix scan.

Each character becomes a symbol (letter, number, other sign, apostrophe that opens a contraction of two or
three characters, blank before a non-blank, other space before a non-blank, space before a space or the
end).  Eight states then say whether a pre-token begins at a character.  A chunk of characters is a map
from eight states to eight states; maps of all chunks compose by doubling, which gives every chunk's entry
state, and a second pass marks the starts in all chunks side by side.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

LETTER, NUMBER, OTHER, APOS2, APOS3, BLANK_LAST, SPACE_LAST, SPACE = range(8)
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHER, HELD_BLANK, IN_SPACE, REST1, REST2 = range(8)
CHUNK = 128
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point: 0 letter, 1 number, 2 other, 3 space."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                table[c] = LETTER
            elif kind == "N":
                table[c] = NUMBER
        for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
            table[c] = 3
        _classes = table
    return _classes


def machine(blanks_attach: bool, numbers_join: bool) -> tuple[np.ndarray, np.ndarray]:
    """next[symbol + 8 * first of its text, state] and starts[...] of one pattern.

    ``blanks_attach``: a blank joins the word after it, and other space makes words of its own; else space
    belongs to no word.  ``numbers_join``: digits in a row make one word.
    """
    step, begins = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for first in (0, 1):
        for symbol in range(8):
            for was in range(8):
                state = CLOSED if first else was
                begin, to = True, CLOSED
                if state in (REST1, REST2):
                    begin, to = False, REST1 if state == REST2 else CLOSED
                elif symbol in (BLANK_LAST, SPACE_LAST, SPACE):
                    if not blanks_attach:
                        begin, to = False, CLOSED
                    elif symbol == SPACE:
                        begin, to = state != IN_SPACE, IN_SPACE
                    else:
                        to = HELD_BLANK if symbol == BLANK_LAST else CLOSED
                elif symbol == LETTER:
                    begin, to = state not in (IN_LETTERS, HELD_BLANK), IN_LETTERS
                elif symbol == NUMBER:
                    begin = not (state == HELD_BLANK or state == IN_NUMBERS and numbers_join)
                    to = IN_NUMBERS
                elif state in (IN_OTHER, HELD_BLANK):
                    begin, to = False, IN_OTHER
                else:
                    to = {OTHER: IN_OTHER, APOS2: REST1, APOS3: REST2}[symbol]
                step[symbol + 8 * first, was], begins[symbol + 8 * first, was] = to, begin
    return step, begins


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Symbols of all characters; ``firsts`` are the first characters of texts, past which nothing looks."""
    kind = classes()[points]
    n = len(points)
    first = np.zeros(n + 3, bool)
    first[firsts] = True
    first[n:] = True
    padded, follow = np.zeros(n + 3, points.dtype), np.full(n + 3, 3, np.uint8)
    padded[:n], follow[:n] = points, kind
    out = kind.copy()
    space = kind == 3
    last = space & ~first[1 : n + 1] & (follow[1 : n + 1] != 3)
    out[space] = SPACE
    out[last] = np.where(points[last] == 32, BLANK_LAST, SPACE_LAST)
    at = np.flatnonzero(points == 39)
    if at.size:
        one, two = padded[at + 1], padded[at + 2]
        single = ~first[at + 1] & np.isin(one, [ord(c) for c in "stmd"])
        pair = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        pair &= ~first[at + 1] & ~first[at + 2]
        out[at[single]] = APOS2
        out[at[pair & ~single]] = APOS3
    out[firsts] += 8
    return out


def starts(codes: np.ndarray, step: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Marks the characters at which a pre-token begins."""
    n = len(codes)
    rows = -(-n // CHUNK)
    padded = np.zeros(rows * CHUNK, np.uint8)
    padded[:n] = codes
    columns = np.ascontiguousarray(padded.reshape(rows, CHUNK).T).astype(np.int16) * 8
    flat = step.ravel()
    # every chunk as a map of entry states to exit states
    maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in columns:
        maps = flat[column[:, None] + maps]
    # inclusive prefix composition by doubling: afterwards maps[i] is the map of chunks 0..i
    reach = 1
    while reach < rows:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    state = np.empty(rows, np.uint8)
    if rows:
        state[0] = CLOSED
        state[1:] = maps[:-1, CLOSED]
    out = np.empty((CHUNK, rows), bool)
    marks = begins.ravel()
    for k, column in enumerate(columns):
        at = column + state
        out[k] = marks[at]
        state = flat[at]
    return out.T.reshape(-1)[:n]


class Words:
    """Words of a list of texts: byte symbols, start and length of each word, and its text's index."""

    def __init__(self, texts: list[str], step: np.ndarray, begins: np.ndarray, drop_space: bool):
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        firsts = (ends - sizes)[sizes > 0]
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offset = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=offset[1:])
        codes = symbols(points, firsts)
        mark = starts(codes, step, begins)
        char = np.flatnonzero(mark)
        self.bytes = data
        self.starts = offset[char]
        if drop_space:
            # a word ends where the next begins or at the first space after it
            space = (codes & 7) >= BLANK_LAST
            cut = mark | space
            cut[firsts] = True
            stops = np.append(np.flatnonzero(cut), len(points))
            char_end = stops[np.searchsorted(stops, char, side="right")]
        else:
            char_end = np.append(char[1:], len(points))
        self.lengths = offset[char_end] - self.starts
        self.text_of = np.searchsorted(ends, char, side="right")
        self.n_bytes = offset[ends] - offset[ends - sizes]


def split_special(texts: list[str], special: list[str]) -> tuple[list[str], list[int], list[tuple[int, str]]]:
    """Texts cut at special strings: pieces, each piece's text, and (piece before it, string) of each special."""
    if not any(s in t for t in texts for s in special):
        return texts, list(range(len(texts))), []
    pattern = re.compile("(" + "|".join(map(re.escape, special)) + ")")
    pieces, owner, found = [], [], []
    for i, text in enumerate(texts):
        for k, part in enumerate(pattern.split(text)):
            if k % 2:
                found.append((len(pieces) - 1, part))
            else:
                pieces.append(part)
                owner.append(i)
    return pieces, owner, found
