import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexloom.llm import op1_token_counts as o1
from lexloom.llm import op2_chat_format as o2
from lexloom.llm import op9_bpe_codec as o9
from lexloom.llm import op10_telephony as o10
from lexloom.llm import queries
from lexloom.llm.common import table

ODD = [
    None, "", " ", "a", "don't we'll I'VE 'tis  two  blanks\n\n tabs\t\tend ", "<|endoftext|> in <|startoftext|>text<|endoftext|>", "é è ÀÉ Σίσυφος ΣΑΣ ǅ İ ß",
    "日本語 テスト 한국어 中文", "😀👩‍👩‍👧 🏳️‍🌈", "é ñ 가", "x" * 5000, "ab" * 3000, "1234567890 ½ Ⅳ ٣", "\x00\x1f​　 \u0085",
    "!?.,;:()[]{}<>/\\|@#$%^&*_+-=~`'\"", "Hello WORLD's don''t ''s 're'll", "\r\n\r\n a b",
]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long").repartition(3)


def texts_of(spark, sf_dir):
    rng = random.Random(1)
    drawn = ["".join(rng.choices("abcdeéß'ñ 中1.\n<|>ES", k=rng.randint(1, 60))) for _ in range(300)]
    return ODD + drawn + [r.text for r in table(spark, sf_dir, "documents").collect()]


def test_counts_equal_the_library(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    out = {r.doc_id: r for r in o1.token_counts(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (out[i].n_bytes, out[i].n_tokens, out[i].over_limit) == (len((t or "").encode()), n, n > 512), (i, t)
    assert o1.token_counts(docs_of(spark, texts).limit(0)).collect() == []


def test_codec_equals_the_library(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    out = {r.doc_id: r for r in o9.round_trip(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        told = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (len(ids), told, decoded), (i, t)


def test_conversations_read_back(spark, sf_dir, monkeypatch):
    turns = table(spark, sf_dir, "conversations")
    out = {r.conv_id: r for r in queries.op2_chat_format_query(spark, sf_dir).collect()}
    by = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in turns.collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    assert set(out) == set(by)
    for i, rows in by.items():
        rows = sorted(rows)
        sha = hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in rows).encode()).hexdigest()
        loss = "".join(text for _, role, text in rows if role == "assistant")
        r = out[i]
        assert (r.n_turns, r.turns_sha256, r.loss_chars) == (len(rows), sha, len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and r.formatted_chars > len(loss)
    monkeypatch.setattr(o2, "FLUSH_CHARS", 10)
    odd = [(1, None, None, None), (1, 2, "assistant", "[\\[<</s>\\"), (1, 3, "user", "x"), (None, 1, "assistant", "é😀"), (2, 1, "user", ""), (2, 1, "user", "")]
    made = {r.conv_id: r for r in o2.format_conversations(spark.createDataFrame(odd, "conv_id long, turn int, role string, text string")).collect()}
    assert made[1].n_turns == 3 and made[1].loss_sha256 == hashlib.sha256("[\\[<</s>\\".encode()).hexdigest()
    assert made[None].loss_chars == 2 and made[2].n_turns == 2 and made[2].loss_chars == 0


def test_media_round_trip(spark, sf_dir):
    texts = texts_of(spark, sf_dir)[:400]
    for r in o10.media_digests(docs_of(spark, texts)).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_bytes > len(payload)
    for codec in ("alaw", "ima_adpcm"):
        row = o10.media_columns(docs_of(spark, ["abc" * 900]), codec, store_pcm=True).first()
        assert bytes(row.payload) == o10.encode_payload("abc" * 900)
        kind, rate, _, pcm = o10.read_wave(bytes(row.pcm))
        assert (kind, rate) == (o10.PCM, o10.OUT_RATE) and len(pcm) > 0


def test_tables_and_adpcm_by_the_formats_rules():
    mu = o10.mulaw_table()
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80]) == (0, 0, -32124, 32124)
    a = o10.alaw_table()
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 8 * 40, dtype=np.uint8).tobytes()
    want = []
    for k in range(0, len(data), 40):
        block = data[k : k + 40]
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        want.append(value)
        for code in (c for byte in block[4:] for c in (byte & 15, byte >> 4)):
            step = int(o10.STEPS[index])
            change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            want.append(value)
    assert o10.decode_ima(data, 40).tolist() == want
