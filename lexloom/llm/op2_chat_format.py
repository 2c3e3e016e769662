"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets (several together, by the byte-pair transducer of
:mod:`bpe_core`), and its sorted turn spans are intersected with the sorted token spans by binary search.  Control strings are single tokens, so no token
straddles the edge of a span.  Texts cannot forge them: after each ``<``, ``[`` and backslash of a role or
text the renderer adds a backslash, which breaks every control string and is undone exactly on reading.

Rows are dealt by conversation, sorted by turn and streamed, so a conversation of any length needs the
memory of one flush (``FLUSH_CHARS``), not of all its turns; digests are carried on.

Defined cases: null role or text is the empty string; ties on ``turn`` are ordered by role, then text (null
turns first); repeated rows are turns of their own; a null ``conv_id`` is one conversation; an empty table
gives only what the caller added; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import pretokens
from lexloom.llm.bpe_core import Machine, Vocabulary
from lexloom.llm.common import released, worker_tables

#: Characters of turns that are gathered before they are rendered and encoded.
FLUSH_CHARS = 4 << 20
#: Rendered characters of several conversations that are encoded together.
TOGETHER = 1 << 20
SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
)


@dataclass(frozen=True)
class Template:
    """Control strings; each begins with ``<`` or ``[``, the characters that texts have escaped."""

    begin: str = "<s>"
    role: str = "[INST]"
    text: str = "[/INST]"
    end: str = "</s>"
    loss_roles: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return [self.begin, self.role, self.text, self.end]


def escape(text: str) -> str:
    return re.sub(r"([<\[\\])", r"\1\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([<\[\\])\\", r"\1", text)


def render(turns: list[tuple[str, str]], template: Template, opening: bool = True) -> tuple[str, np.ndarray]:
    """Formatted text and the sorted [start, end) spans of the texts under the loss mask."""
    parts, spans, at = [template.begin] if opening else [], [], len(template.begin) if opening else 0
    for role, text in turns:
        head, body = template.role + escape(role) + template.text, escape(text)
        if role in template.loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, template.end]
        at += len(head) + len(body) + len(template.end)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str, template: Template) -> list[tuple[str, str]]:
    """Turns read back from formatted text."""
    turns = []
    for piece in formatted.removeprefix(template.begin).split(template.end)[:-1]:
        role, text = piece.removeprefix(template.role).split(template.text, 1)
        turns.append((unescape(role), unescape(text)))
    return turns


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one token of each span, by binary search in the sorted token starts."""
    begin = offsets[:, 0]
    return np.searchsorted(begin, spans[:, 0], "left"), np.searchsorted(begin, spans[:, 1], "left")


class Encoder:
    """Token offsets of texts, by the byte-pair transducer; control strings are single tokens.  One a worker."""

    _made: dict[tuple, "Encoder"] = worker_tables(__name__)

    def __init__(self, path: str, template: Template):
        vocabulary = Vocabulary(path)
        self.machine, self.whole = Machine(vocabulary), [*template.controls, *vocabulary.special]
        self.step, self.begins = pretokens.machine(blanks_attach=True, numbers_join=True)

    @classmethod
    def of(cls, path: str, template: Template) -> "Encoder":
        if (path, template) not in cls._made:
            cls._made[path, template] = cls(path, template)
        return cls._made[path, template]

    def offsets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted [start, end) characters of the tokens of each text; a token inside a character has that one's."""
        pieces, owner, found = pretokens.split_special(texts, self.whole)
        words = pretokens.Words(pieces, self.step, self.begins, drop_space=False)
        counts, last = self.machine.run(words.bytes, words.starts, words.lengths, keep=True)
        size = self.machine.length[self.machine.follow(last, words.starts, words.lengths, counts)]
        # tokens tile the joined pieces: bytes, then characters there, then characters of the joined texts
        ends = np.cumsum(size)
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        byte = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000), out=byte[1:])
        start, end = np.searchsorted(byte, ends - size, "right") - 1, np.searchsorted(byte, ends, "left")
        long = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stop = np.cumsum(long)
        piece = np.searchsorted(stop, start, "right")
        gap = np.zeros(len(pieces) + 1, np.int64)  # characters of control strings before each piece
        for k, whole in found:
            gap[k + 1] += len(whole)
        shift = np.cumsum(gap)[:-1]
        first = np.array([stop[k] + shift[k] for k, _ in found], np.int64)
        begin = np.concatenate([start + shift[piece], first])
        finish = np.concatenate([end + shift[piece], first + np.array([len(x) for _, x in found], np.int64)])
        order = np.argsort(begin, kind="stable")
        both = np.stack([begin[order], finish[order]], axis=1)
        base = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        cut = np.searchsorted(both[:, 0], base)
        return [both[a:b] - at for a, b, at in zip(cut, cut[1:], base)]


class _Conversation:
    """Running digests of one conversation, fed by flushes of whole turns."""

    def __init__(self, conv_id, template: Template):
        self.conv_id, self.template = conv_id, template
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.tokens = self.loss_tokens = 0
        self.waiting: list[tuple[str, str]] = []
        self.size = 0
        self.opened = False

    def render(self) -> tuple[str, np.ndarray]:
        """The waiting turns, rendered; they are told by :meth:`take` once they are encoded."""
        out = render(self.waiting, self.template, not self.opened)
        self.waiting, self.size, self.opened = [], 0, True
        return out

    def take(self, formatted: str, spans: np.ndarray, offsets: np.ndarray) -> None:
        self.tokens += len(offsets)
        self.chars += len(formatted)
        for role, text in parse(formatted, self.template):
            self.n_turns += 1
            self.turns_sha.update(f"{role}\n{text}\n".encode())
        for lo, hi in zip(*token_mask(offsets, spans)):
            self.loss_tokens += int(hi - lo)
            if hi > lo:
                text = unescape(formatted[offsets[lo, 0] : offsets[hi - 1, 1]])
                self.loss_chars += len(text)
                self.loss_sha.update(text.encode())

    def row(self) -> tuple:
        return (
            self.conv_id, self.n_turns, self.turns_sha.hexdigest(), self.loss_chars,
            self.loss_sha.hexdigest(), self.chars, self.tokens, self.loss_tokens,
        )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = [p.split()[0] for p in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def format_conversations(turns: DataFrame, path: str | None = None, template: Template = Template()) -> DataFrame:
    """One row per conversation, read back from its formatted text and token mask."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        encoder, now, rendered, size = Encoder.of(path, template), None, [], 0

        def encoded():
            """Rows of the conversations that are over, after all rendered turns have been encoded together."""
            done = []
            for (conversation, formatted, spans, over), offsets in zip(rendered, encoder.offsets([r[1] for r in rendered])):
                conversation.take(formatted, spans, offsets)
                if over:
                    done.append(conversation.row())
            rendered.clear()
            return done

        def turns_of():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")))
            yield None

        for turn in turns_of():
            if now is not None and (turn is None or turn[0] != now.conv_id or now.size >= FLUSH_CHARS):
                over = turn is None or turn[0] != now.conv_id
                rendered.append((now, *now.render(), over))
                size += len(rendered[-1][1])
                now = None if over else now
                if size >= TOGETHER or turn is None:
                    if done := encoded():
                        yield _batch(done)
                    size = 0
            if turn is not None:
                if now is None:
                    now = _Conversation(turn[0], template)
                text = turn[2] or ""
                now.waiting.append((turn[1] or "", text))
                now.size += len(text)

    ordered = (
        turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return ordered.mapInArrow(released(run), SCHEMA)

