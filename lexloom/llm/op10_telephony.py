"""Media columns for telephony audio: mu-law, A-law and IMA ADPCM in RIFF/WAVE files.

Companded bytes are expanded by 256-entry lookup tables; ADPCM blocks are decoded with numpy across all
blocks of many files side by side; the PCM is resampled by linear interpolation in integers and can be stored.

``encode_payload`` stores a document's bytes as 8-bit samples without loss; ``media_columns`` writes the
files of one codec and reads payload and features back from them, ``media_forms`` those of all three with their PCM.

Defined cases: a null or empty text is the empty byte string, padded to one unit; equal texts give equal
values whatever their ids; repeated rows are stored row by row; an empty table gives an empty table.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import per_document

UNIT = 576
RATE, OUT_RATE = 8000, 16000
PCM, ALAW, MULAW, IMA = 1, 6, 7, 0x11
CODECS = {"alaw": ALAW, "mulaw": MULAW, "ima_adpcm": IMA}

# Fixed values of the ADPCM format: step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157,
    173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878,
    2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289,
    16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit PCM of the 256 mu-law codes."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 0x84) << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit PCM of the 256 A-law codes."""
    code = np.arange(256) ^ 0x55
    segment, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


_TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_ima(data: bytes, align: int) -> np.ndarray:
    """Mono IMA ADPCM: all blocks of ``align`` bytes advance together, one nibble a step."""
    count = len(data) // align
    blocks = np.frombuffer(data, np.uint8, count * align).reshape(count, align)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * body.shape[0], count), np.int16)
    out[0] = value
    for k, byte in enumerate(body):
        for half, code in ((1, byte & 15), (2, byte >> 4)):
            step, size = STEPS[index], code.astype(np.int32)
            change = (step >> 3) + (step >> 2) * (size & 1) + (step >> 1) * (size >> 1 & 1) + step * (size >> 2 & 1)
            value = np.clip(np.where(size & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + INDEX_CHANGE[size], 0, 88)
            out[2 * k + half] = value
    return out.T.ravel()


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in integers; the last sample is held."""
    n = len(pcm) * to // rate
    if not n:
        return np.zeros(0, np.int16)
    if to == 2 * rate:
        out = np.empty(n, np.int16)
        out[::2] = pcm
        wide = pcm.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    at = np.arange(n, dtype=np.int64) * rate
    base, part = at // to, at % to
    wide = pcm.astype(np.int64)
    return (wide[base] + (wide[np.minimum(base + 1, len(pcm) - 1)] - wide[base]) * part // to).astype(np.int16)


def write_wave(payload: bytes, codec: int, rate: int = RATE, align: int = 1) -> bytes:
    """A RIFF/WAVE file around ``payload``; IMA files carry their block size and samples a block."""
    bits = {PCM: 16, IMA: 4}.get(codec, 8)
    extra = struct.pack("<HH", 2, 1 + 2 * (align - 4)) if codec == IMA else b"" if codec == PCM else struct.pack("<H", 0)
    speed = rate * align // (1 + 2 * (align - 4)) if codec == IMA else rate * align
    fmt = struct.pack("<HHIIHH", codec, 1, rate, speed, align, bits) + extra
    samples = len(payload) // align * (1 + 2 * (align - 4)) if codec == IMA else len(payload) // align
    fact = b"" if codec == PCM else b"fact" + struct.pack("<II", 4, samples)
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, int, bytes]:
    """codec, rate, block size and payload of a file of :func:`write_wave` or any mono RIFF/WAVE."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt, payload = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            payload = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if fmt is None or payload is None:
        raise ValueError("a WAVE file needs fmt and data chunks")
    return fmt[0], fmt[2], fmt[4], payload


def to_pcm(codec: int, payload: bytes, align: int) -> np.ndarray:
    if codec == IMA:
        return decode_ima(payload, align)
    if codec == PCM:
        return np.frombuffer(payload, "<i2")
    return _TABLES[codec][np.frombuffer(payload, np.uint8)]


def features(pcm: np.ndarray, rate: int) -> str:
    """Duration in ms, peak, mean square and zero crossings of 16-bit PCM, all integers."""
    wide = pcm.astype(np.int32)
    energy = int((wide.astype(np.float64) ** 2).sum()) // max(1, len(pcm))
    crossings = int(np.count_nonzero(np.diff(np.signbit(pcm))))
    return f"ms={len(pcm) * 1000 // rate};peak={int(np.abs(wide).max(initial=0))};power={energy};zc={crossings}"


def encode_payload(text: str, unit: int = UNIT) -> bytes:
    """UTF-8 of a text, filled up with bytes 255 to a positive multiple of ``unit``."""
    raw = text.encode()
    return raw + b"\xff" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def media_columns(docs: DataFrame, codec: str = "mulaw", store_pcm: bool = False) -> DataFrame:
    """doc_id, n_bytes, media (the file), payload (read back), feature; with ``store_pcm`` the resampled PCM file too."""
    extra = ", pcm binary" if store_pcm else ""

    def work(rows):
        out = stored(rows["text"], codec)
        return out | {"doc_id": rows["doc_id"], "n_bytes": [len(t.encode()) for t in rows["text"]]}

    return per_document(docs, ["doc_id", "text"], "doc_id long, n_bytes long, media binary, payload binary, feature string" + extra, work)


def stored(texts: list[str], codec: str) -> dict[str, list]:
    """media, payload, feature and pcm (a file of the resampled PCM) of each text; ADPCM blocks of all texts are decoded together."""
    kind, align = CODECS[codec], UNIT // 2 if codec == "ima_adpcm" else 1
    out: dict[str, list] = {"media": [write_wave(encode_payload(t), kind, RATE, align) for t in texts]}
    read = [read_wave(m) for m in out["media"]]
    out["payload"] = [payload for *_, payload in read]
    sizes = np.array([len(p) // align for p in out["payload"]], np.int64) * (1 + 2 * (align - 4) if kind == IMA else 1)
    decoded = np.split(to_pcm(kind, b"".join(out["payload"]), align), np.cumsum(sizes)[:-1])
    pcms = [resample(pcm, rate, OUT_RATE) for pcm, (_, rate, _, _) in zip(decoded, read)]
    out["feature"] = [features(pcm, OUT_RATE) for pcm in pcms]
    out["pcm"] = [write_wave(pcm.astype("<i2").tobytes(), PCM, OUT_RATE, 2) for pcm in pcms]
    return out


def media_forms(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and of each codec ``<codec>_media``, ``_payload``, ``_feature`` and ``_pcm``."""
    kinds = {"media": "binary", "payload": "binary", "feature": "string", "pcm": "binary"}
    schema = ", ".join(f"{codec}_{name} {kind}" for codec in CODECS for name, kind in kinds.items())

    def work(rows):
        out = {f"{codec}_{name}": column for codec in CODECS for name, column in stored(rows["text"], codec).items()}
        return out | {"doc_id": rows["doc_id"], "n_bytes": [len(t.encode()) for t in rows["text"]]}

    return per_document(docs, ["doc_id", "text"], "doc_id long, n_bytes long, " + schema, work)


def media_digests(docs: DataFrame) -> DataFrame:
    """The stored media and PCM of all codecs as lengths, digests and features; columns without a codec's name are of mu-law."""
    m = media_forms(docs)
    tail = F.expr("substring(mulaw_payload, greatest(octet_length(mulaw_payload) - 31, 1), 32)")

    def told(codec, prefix):
        return [
            F.octet_length(f"{codec}_media").cast("long").alias(f"{prefix}media_bytes"),
            F.sha2(f"{codec}_media", 256).alias(f"{prefix}media_sha256"),
            F.col(f"{codec}_feature").alias(f"{prefix}feature"),
            F.octet_length(f"{codec}_pcm").cast("long").alias(f"{prefix}pcm_bytes"),
            F.sha2(f"{codec}_pcm", 256).alias(f"{prefix}pcm_sha256"),
        ]

    return m.select(
        "doc_id", "n_bytes",
        F.octet_length("mulaw_payload").cast("long").alias("payload_bytes"),
        F.sha2("mulaw_payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        *told("mulaw", ""),
        *[c for codec in ("alaw", "ima_adpcm") for c in (F.sha2(f"{codec}_payload", 256).alias(f"{codec}_payload_sha256"), *told(codec, f"{codec}_"))],
    )
