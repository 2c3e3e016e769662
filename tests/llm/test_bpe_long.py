import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexloom.llm import bpe_core
from lexloom.llm.op1_token_counts import TokenCounter
from lexloom.llm.op9_bpe_codec import WordCodec


def library(name):
    made = Tokenizer.from_file(public_tokenizers.path(name))
    made.no_truncation()
    made.no_padding()
    return lambda texts: [e.ids for e in made.encode_batch(texts, add_special_tokens=False)]


def texts():
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(rng.choice(letters, 14)) for _ in range(2500)]
    return [
        " ".join(words),
        "".join(rng.choice(letters, 60_000)),
        "a" * 50_001,
        "ab" * 30_000 + "c",
        "".join(rng.choice(np.array(list("aeé你")), 20_000)),
        "the" * 9_000 + " end " + "x" * 1025 + " " + "y" * 1024,
    ]


@pytest.mark.parametrize("limits", [(1 << 19, 1 << 17), (3000, 700)])
def test_long_words_and_full_tables_equal_the_library(monkeypatch, limits):
    monkeypatch.setattr(bpe_core, "MAX_TRANSITIONS", limits[0])
    monkeypatch.setattr(bpe_core, "LANES", limits[1])
    made = texts()
    for group in (made, *([t] for t in made)):
        counter = TokenCounter(public_tokenizers.path("byte_bpe_50k.json"))
        assert counter.count(group)[1].tolist() == [len(i) for i in library("byte_bpe_50k.json")(group)]
        assert counter.machine.filled <= sum(limits)
        codec = WordCodec(public_tokenizers.path("word_bpe_49k.json"))
        assert [i.tolist() for i in codec.encode(group)] == library("word_bpe_49k.json")(group)
