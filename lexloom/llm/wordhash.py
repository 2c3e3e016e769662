"""Words of whole texts as 64-bit hashes, with numpy over blocks of texts.

A word is a longest run outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z.  Its hash is a polynomial in
its bytes modulo 2**64, taken as a difference of running sums, then mixed.
"""

from __future__ import annotations

import numpy as np

_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on each other."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting (which is several times faster here than hashing)."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def forget() -> None:
    """Drops what is kept for the next block of texts; it is made anew in milliseconds."""
    _powers.clear()


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = 1 << max(16, (n - 1).bit_length())
        held = np.full(size, base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        _powers[base] = held
    return held[:n]


def _runs(encoded: list[bytes], inside: np.ndarray, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hash of every run of ``inside`` bytes, runs of each text, size of every run, and hashes of the runs' heads."""
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside[data], [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_R, len(data)), out=total[1:])
    hashes = mix((total[end] - total[start]) * _power(_R_INVERSE, len(data) + 1)[start])
    ends = np.cumsum(np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded)))
    first = [mix((total[np.minimum(start + n, end)] - total[start]) * _power(_R_INVERSE, len(data) + 1)[start], n) for n in heads]
    return hashes, np.diff(np.searchsorted(start, ends, "left"), prepend=0), end - start, *first


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and words of each text."""
    return _runs([t.encode().lower() for t in texts], ~_SPACE)[:2]


def runs(texts: list[str], inside: np.ndarray, lower: bool, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """As :func:`words` for runs of other bytes, with sizes and hashes of the first ``heads`` bytes of each run.

    ``inside`` must leave out the line feed.
    """
    return _runs([t.lower().encode() if lower else t.encode() for t in texts], inside, heads)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's words; fewer words make one shingle, none make none."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(width, n)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = mix(out, size) + hashes[k : n - size + 1 + k]
    return distinct(mix(out, size))
