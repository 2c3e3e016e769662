import random

import numpy as np

from lexloom.llm import op3_language_id as op

HAN = [chr(0x4E00 + k) for k in range(600)]


def samples():
    rng = random.Random(5)
    low = "".join(chr(c) for c in range(0x61, 0x600) if chr(c).isalpha() and chr(c) == chr(c).lower())
    return {"aa": [low], "ja": ["".join(rng.choices(HAN[:300], k=900))], "zh": ["".join(rng.choices(HAN[300:], k=900))]}


def test_letters_of_all_scripts_count():
    made = op.Identifier(samples())
    rng = random.Random(6)
    texts = ["".join(rng.choices(HAN[300:], k=40)), "".join(rng.choices(HAN[:300], k=40)), "abcdefgh"]
    assert made.predict(texts)[0] == ["zh", "ja", "aa"]


def test_hashed_transitions_equal_dense_ones(monkeypatch):
    rng = random.Random(7)
    texts = ["", "x", "zz Ж"] + ["".join(rng.choices(HAN + list("abc "), k=rng.randint(1, 1500))) for _ in range(50)]
    texts += [samples()["zh"][0][30:400], samples()["aa"][0]]
    dense = op.Identifier(samples()).phrases(texts)
    monkeypatch.setattr(op, "DENSE", 0)
    hashed = op.Identifier(samples())
    assert all(s.keys is not None for s in hashed.steps) and (hashed.phrases(texts) == dense).all()
    assert np.ptp(dense, axis=1).max() > 100


def test_no_language_is_left_out(spark):
    rows = [(k * 8 + i, "abc def " * 300, f"l{k}") for k in range(520) for i in range(8)]
    got = op.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    held = {k for k in range(520) if all(op.is_held_out(k * 8 + i) for i in range(8))}
    assert set(got) == {f"l{k}" for k in range(520) if k not in held}
    assert all(set(v) == {"abc def " * 300} for v in got.values())


def test_whole_texts_whatever_other_languages_there_are(spark):
    rows = [(k, f"start {k} " + "aaa bbb " * 400 + f"end{k}", "en") for k in range(60)] + [(1000 + k, "lange " * 20_000 + "ß" * k, "de") for k in range(1, 9)]
    alone = op.learn(spark.createDataFrame(rows[:60], "doc_id long, text string, lang string"))
    both = op.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = {t for _, t, _ in rows}
    assert alone["en"] == both["en"] and all(t in texts for v in both.values() for t in v)
    assert op.LANGUAGE_CHARS * 0.9 < sum(map(len, both["en"])) <= op.LANGUAGE_CHARS
    # all of one language are beyond the bound: the shortest is taken, whole
    assert len(both["de"]) == 1 and len(both["de"][0]) == min(len(t) for i, t, lang in rows if lang == "de" and not op.is_held_out(i))
