"""Decoding, resampling and features against plain loops over samples."""

import re
import struct

import numpy as np

from lexloom.llm import op10_telephony as op


def mulaw(code):
    code = ~code & 0xFF
    size = (((code & 0x0F) * 2 + 33) << (code >> 4 & 7)) - 33  # in 14 bits
    return (-size if code & 0x80 else size) * 4


def alaw(code):
    code ^= 0x55
    segment, low = code >> 4 & 7, code & 15
    size = 2 * low + 1 if segment == 0 else (2 * low + 33) << (segment - 1)  # in 13 bits
    return (size if code & 0x80 else -size) * 8


def ima(block):
    value, index = struct.unpack_from("<hB", block)
    out, index = [value], min(index, 88)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step, change = int(op.STEPS[index]), int(op.STEPS[index]) >> 3
            change += step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def plain_resample(pcm, rate, to):
    out = []
    for k in range(len(pcm) * to // rate):
        base, part = divmod(k * rate, to)
        after = pcm[min(base + 1, len(pcm) - 1)]
        out.append(pcm[base] + (after - pcm[base]) * part // to)
    return out


def test_tables():
    assert op.mulaw_table().tolist() == [mulaw(c) for c in range(256)]
    assert op.alaw_table().tolist() == [alaw(c) for c in range(256)]


def test_blocks_side_by_side():
    data = np.random.default_rng(3).integers(0, 256, 36 * 40, dtype=np.uint8).tobytes()
    want = [x for k in range(40) for x in ima(data[36 * k : 36 * k + 36])]
    assert op.decode_ima(data, 36).tolist() == want


def test_resampling():
    pcm = np.random.default_rng(5).integers(-32768, 32768, 301).astype(np.int16)
    for rate, to in ((8000, 16000), (8000, 11025), (16000, 8000), (8000, 8000)):
        assert op.resample(pcm, rate, to).tolist() == plain_resample(pcm.tolist(), rate, to), (rate, to)
    assert op.resample(pcm[:0], 8000, 16000).tolist() == [] and op.resample(pcm[:1], 8000, 16000).tolist() == [int(pcm[0])] * 2


def test_features_of_stored_forms():
    for codec in op.CODECS:
        out = op.stored(["some text", "", "é" * 999], codec)
        for pcm, told in zip(out["pcm"], out["feature"]):
            _, rate, _, body = op.read_wave(pcm)
            x = [v for (v,) in struct.iter_unpack("<h", body)]
            crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
            want = f"ms={len(x) * 1000 // rate};peak={max(map(abs, x))};power={sum(v * v for v in x) // len(x)};zc={crossings}"
            assert told == want and re.fullmatch(r"ms=\d+;peak=\d+;power=\d+;zc=\d+", told)
