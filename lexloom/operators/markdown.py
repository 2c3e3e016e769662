"""Markdown: one pass over the lines of a file, with its fences; positions are characters."""

from __future__ import annotations

import re
from collections.abc import Iterator

from lexloom import fixed_values as V

Span = tuple[int, int, str]
_FENCE = re.compile(r"\s*(`{3}|~{3})")
_PREFIX, _RULE, _HEADING = re.compile(V.MARKDOWN_PREFIX), re.compile(V.TABLE_RULE), re.compile(r"\s*#{1,6}\s+")
_LABEL, _URL = re.compile(V.LINK_LABEL), re.compile(V.URL)
_TOKENS = [re.compile(p) for p in (V.PROTECTED, V.INLINE_CODE, V.URL)]
_HAN = re.compile(V.HAN_CHARS)


def fenced(lines: list[str], switch: bool = False) -> list[bool]:
    """Which lines are fence marks or lie inside a fence.

    Another mark inside a fence changes it with ``switch`` (the in-place way), else it is text within the fence.
    """
    out, opened = [], ""
    for line in lines:
        m = _FENCE.match(line)
        out.append(bool(m or opened))
        if m and (not opened or switch or opened == m[1]):
            opened = "" if opened == m[1] else m[1]
    return out


def is_prose(text: str) -> bool:
    """Whether something is left without protected tokens, inline code and addresses."""
    for pattern in _TOKENS:
        text = pattern.sub("", text)
    return bool(text.strip())


def outside(text: str, switch: bool = False) -> Iterator[tuple[int, str]]:
    """(place, line) of the lines outside fences, without carriage returns at their ends."""
    lines, at = text.split("\n"), 0
    for line, inside in zip(lines, fenced(lines, switch)):
        if not inside:
            yield at, line.rstrip("\r")
        at += len(line) + 1


def _cells(line: str) -> Iterator[tuple[int, int]]:
    at = 0
    for cell in line.split("|"):
        body = cell.strip()
        if body:
            start = at + len(cell) - len(cell.lstrip())
            yield start, start + len(body)
        at += len(cell) + 1


def markdown(text: str, suffix: str = ".md") -> list[Span]:
    """Headings, paragraphs, table cells and link labels; labels of a paragraph overlap it."""
    out: list[Span] = []
    for at, line in outside(text):
        if line.strip().startswith("|"):
            if not _RULE.search(line):
                out += [(at + a, at + b, "markdown_table_cell") for a, b in _cells(line) if is_prose(line[a:b])]
            continue
        prefix = _PREFIX.match(line)[1]
        body = line[len(prefix) :]
        if is_prose(_URL.sub("", _LABEL.sub("", body))):
            out.append((at + len(prefix), at + len(line), "markdown_heading" if _HEADING.match(prefix) else "markdown_paragraph"))
        out += [(at + m.start(1), at + m.end(1), "markdown_link_label") for m in _LABEL.finditer(line) if is_prose(m[1])]
    return out


def inplace(text: str, han_only: bool = True) -> Iterator[tuple[int, int]]:
    """What is rewritten in place: cells with Han characters, and other lines without their prefix."""
    for at, line in outside(text, switch=True):
        if han_only and not _HAN.search(line):
            continue
        if line.strip().startswith("|"):
            if not _RULE.search(line):
                yield from ((at + a, at + b) for a, b in _cells(line) if _HAN.search(line, a, b))
            continue
        prefix = len(_PREFIX.match(line)[1])
        if line[prefix:].strip():
            yield at + prefix, at + len(line)
