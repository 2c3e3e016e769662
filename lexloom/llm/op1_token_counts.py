"""Token counts by compiled finite-state transducers.

A small transducer cuts texts into pre-tokens (:mod:`pretokens`: chunk state maps, parallel prefix scan);
the vocabulary's transducer (:mod:`bpe_core`) then steps through all pre-tokens at once and sums the counts
that its transitions carry.  Counts equal those of the tokenizers library, without added tokens.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special strings in a text count as the
library counts them by default (one token each); repeated rows and ids are counted row by row; an empty
table gives an empty table; other columns are ignored.  A text is never cut: a word of any length is one lane.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from lexloom.llm import pretokens
from lexloom.llm.bpe_core import Machine, Vocabulary
from lexloom.llm.common import per_document, worker_tables

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class TokenCounter:
    """Counts for lists of texts; one a worker and vocabulary."""

    _made: dict[str, "TokenCounter"] = worker_tables(__name__)

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.machine = Machine(self.vocabulary)
        self.step, self.begins = pretokens.machine(blanks_attach=True, numbers_join=True)

    @classmethod
    def of(cls, path: str) -> "TokenCounter":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of each text."""
        pieces, owner, found = pretokens.split_special(texts, list(self.vocabulary.special))
        words = pretokens.Words(pieces, self.step, self.begins, drop_space=False)
        counts, _ = self.machine.run(words.bytes, words.starts, words.lengths, keep=False)
        by_piece = np.bincount(words.text_of, counts, len(pieces)).astype(np.int64)
        owners = np.asarray(owner, np.int64)
        tokens = np.bincount(owners, by_piece, len(texts)).astype(np.int64)
        n_bytes = np.bincount(owners, words.n_bytes, len(texts)).astype(np.int64)
        for piece, text in found:
            tokens[owner[piece]] += 1
            n_bytes[owner[piece]] += len(text.encode())
        return n_bytes, tokens


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of ``docs``."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def work(rows):
        n_bytes, tokens = TokenCounter.of(path).count(rows["text"])
        return {"doc_id": rows["doc_id"], "n_bytes": n_bytes, "n_tokens": tokens, "over_limit": tokens > limit}

    return per_document(docs, ["doc_id", "text"], SCHEMA, work)
