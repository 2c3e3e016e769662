"""BPE encoding and decoding by per-prefix dynamic programming.

Every prefix of a word has one last token (:mod:`bpe_core`: suffix-chain matches and pair-compatibility
tests); the machine stores it for each position, and back-pointers from a word's end give the exact ids.
Decoding reads the stored ids back and joins their vocabulary strings as the library does for a file
without a decoder: with one blank between tokens.

Defined cases: a null or empty text has no ids and decodes to the empty string; special strings in a text
become their own ids, as the library does by default; repeated rows are encoded row by row; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from lexloom.llm import pretokens
from lexloom.llm.bpe_core import Machine, Vocabulary
from lexloom.llm.common import per_document, worker_tables

#: Ranges whose characters NFC can change or compose with; texts without them are NFC already.
_NFC_RISK = re.compile("[̀-\U0010ffff]")


def normalise(text: str) -> str:
    """NFC, then lower case character by character (no final-sigma rule).  Spaces only part words."""
    if _NFC_RISK.search(text):
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class WordCodec:
    """Encoder and decoder of one vocabulary with word-end symbols; one a worker."""

    _made: dict[str, "WordCodec"] = worker_tables(__name__)

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.machine = Machine(self.vocabulary)
        self.step, self.begins = pretokens.machine(blanks_attach=False, numbers_join=False)
        v = self.vocabulary
        self.strings = np.array([v.text.get(i, "").encode() for i in range(max(v.text) + 1)], object)

    @classmethod
    def of(cls, path: str) -> "WordCodec":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of each text."""
        v = self.vocabulary
        pieces, owner, found = pretokens.split_special(texts, list(v.special))
        words = pretokens.Words([normalise(p) for p in pieces], self.step, self.begins, drop_space=True)
        symbols = words.bytes.astype(np.int16)
        if v.suffix:
            symbols[words.starts + words.lengths - 1] += 256
        counts, last = self.machine.run(symbols, words.starts, words.lengths, keep=True)
        ids = self.machine.follow(last, words.starts, words.lengths, counts)
        per = np.bincount(words.text_of, counts, len(pieces)).astype(np.int64)
        cut = np.split(ids, np.cumsum(per)[:-1]) if len(pieces) else []
        if not found:
            return cut
        after = {piece: v.special[text] for piece, text in found}
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for k, part in enumerate(cut):
            out[owner[k]].append(part)
            if k in after:
                out[owner[k]].append(np.array([after[k]], np.uint32))
        return [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that the ids stand for, special tokens kept."""
        return b" ".join(self.strings[ids].tolist())


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, as binary), n_tokens."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def work(rows):
        ids = WordCodec.of(path).encode(rows["text"])
        return {"doc_id": rows["doc_id"], "ids": [i.astype("<u4").tobytes() for i in ids], "n_tokens": [len(i) for i in ids]}

    return per_document(docs, ["doc_id", "text"], "doc_id long, ids binary, n_tokens long", work)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of the ids and of the text decoded from them; both in one pass over the stored ids."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def work(rows):
        codec = WordCodec.of(path)
        stored = [i.astype("<u4").tobytes() for i in codec.encode(rows["text"])]
        decoded = (codec.decode(np.frombuffer(b, "<u4")) for b in stored)
        return {
            "doc_id": rows["doc_id"],
            "n_tokens": [len(b) // 4 for b in stored],
            "ids_sha256": [hashlib.sha256(b).hexdigest() for b in stored],
            "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded],
        }

    return per_document(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
