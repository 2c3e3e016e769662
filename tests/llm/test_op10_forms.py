import hashlib

from lexloom.llm import op10_telephony as op


def test_the_query_decodes_all_codecs_and_stores_pcm(spark):
    texts = ["", "abc", "é😀 " * 300, "x" * 5000, "abc", "Zwei Blöcke. " * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = {r.doc_id: r for r in op.media_digests(docs).collect()}
    assert sorted(rows) == list(range(len(texts)))
    for i, text in enumerate(texts):
        raw = op.encode_payload(text)
        for codec, prefix in (("mulaw", ""), ("alaw", "alaw_"), ("ima_adpcm", "ima_adpcm_")):
            kind, align = op.CODECS[codec], op.UNIT // 2 if codec == "ima_adpcm" else 1
            media = op.write_wave(raw, kind, op.RATE, align)
            pcm = op.resample(op.to_pcm(kind, raw, align), op.RATE, op.OUT_RATE)  # one file by itself
            stored = op.write_wave(pcm.astype("<i2").tobytes(), op.PCM, op.OUT_RATE, 2)
            want = {
                "payload_sha256": hashlib.sha256(raw).hexdigest(),
                "media_bytes": len(media),
                "media_sha256": hashlib.sha256(media).hexdigest(),
                "feature": op.features(pcm, op.OUT_RATE),
                "pcm_bytes": len(stored),
                "pcm_sha256": hashlib.sha256(stored).hexdigest(),
            }
            assert {k: rows[i][prefix + k] for k in want} == want, (i, codec)
