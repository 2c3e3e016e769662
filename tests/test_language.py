"""The detector: its profile against plain counting, accuracy on labelled documents, rules before the profile, files."""

import random
from collections import Counter
from math import floor, log

from pyspark.sql import functions as F

from lexloom import cli
from lexloom.functions import language, ngrams
from lexloom.plans import catalogue


def plain_grams(text):
    s = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in (text or '').lower()).split())} "
    s = " " if s == "  " else s
    return [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n] != " "]


def made(seed, n):
    rng = random.Random(seed)
    words = {"aa": ["ana", "banana", "über", "x"], "bb": ["tuk", "kut", "ñandú", "х"], "cc": ["日本", "ana", "tuk"]}
    return [(k, " ".join(rng.choices(words[lang], k=rng.randint(0, 30))) + rng.choice(["!", " 12", ""]), lang) for k, lang in enumerate(rng.choices(list(words), k=n))]


def test_profile_equals_plain_counting(spark):
    rows = [*made(1, 200), (900, None, "aa"), (901, "text", None)]
    table = ngrams.train(spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(5), kept=20)
    counts = {}
    for _, text, lang in rows:
        if lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    known = {g for c in counts.values() for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:20]}
    want = {(lang, g): c[g] for lang, c in counts.items() for g in known if c[g]}
    assert {(r.lang, r.gram): r.n for r in table.collect()} == want
    profile = ngrams.Profile.of(table)
    texts = ["Ana über banana", "kut TUK", "", None, "ана", "日本 日本"]
    total = {lang: sum(n for (x, _), n in want.items() if x == lang) for lang in counts}
    weight = lambda lang, g: floor(1000 * log((want.get((lang, g), 0) + 0.5) / (total[lang] + 0.5 * len(known))))
    scores, met = profile.scores(texts)
    for k, text in enumerate(texts):
        own = [g for g in plain_grams(text) if g in known]
        assert met[k] == len(own) and scores[k].tolist() == [sum(weight(lang, g) for g in own) for lang in sorted(counts)]
    ngrams.CELLS, kept = 0, ngrams.CELLS
    try:  # searched instead of looked up in a table
        searched = ngrams.Profile.of(table)
        assert searched.table is None and all((x == y).all() for x, y in zip(searched.scores(texts * 9), profile.scores(texts * 9)))
    finally:
        ngrams.CELLS = kept
    ngrams.BLOCK, kept = 10, ngrams.BLOCK
    try:
        assert (profile.scores(texts)[0] == scores).all() and profile.scores(texts)[1].tolist() == met.tolist()
    finally:
        ngrams.BLOCK = kept
    assert profile.best(texts)[:4] == ["aa", "bb", None, None] and profile.best(texts)[5] == "cc"
    assert all(ngrams.spelled(ngrams.key_of(g)) == g for g in known)


def test_accuracy_on_documents(spark, sf_dir):
    rows = {r.learned: r for r in catalogue.q79(spark, sf_dir).collect()}
    assert set(rows) == {True, False} and all(r.agreed >= 0.95 * r.n for r in rows.values())


def test_rules_before_the_profile(spark):
    profile = ngrams.Profile.of(ngrams.train(spark.createDataFrame(made(2, 200), "doc_id int, text string, lang string")))
    texts = ["ana banana über x ana", "这是一个很长的中文句子吗", "これは長い日本語の文です", "이것은 긴 한국어 문장입니다", "это длинное русское предложение", "ana", None, "12345 67890 !!", "tuk kut tuk kut " + "Ж" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    told = [r.d for r in df.select("n", language.detect(F.col("t"), profile).alias("d")).orderBy("n").collect()]
    assert told == ["aa", "zh", "ja", "ko", "ru", None, None, None, "bb"]
    plain = [r.d for r in df.select("n", language.detect(F.col("t")).alias("d")).orderBy("n").collect()]
    assert plain[1:5] == ["zh", "ja", "ko", "ru"]
    long = spark.createDataFrame([("ana banana " * 100 + "kut ñandú " * 1000,)], "t string")
    assert [long.select(language.detect(F.col("t"), profile, seen).alias("d")).first().d for seen in (1000, None)] == ["aa", "bb"]


def test_command_line_learns_a_profile_and_detects(spark, tmp_path, capsys):
    spark.createDataFrame(made(3, 300), "doc_id int, text string, lang string").write.parquet(str(tmp_path / "labelled"))
    assert cli.main(["learn-languages", str(tmp_path / "labelled"), str(tmp_path / "profile")], spark) == 0
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.md").write_text("# tuk kut ñandú\n\n- tuk kut tuk\n")
    (root / "b.py").write_text("x = 1  # ana\n# banana ana über banana\n")
    assert cli.main(["detect", str(root), "--profile", str(tmp_path / "profile"), "--translate-code"], spark) == 0
    said = capsys.readouterr().out
    assert "a.md bb 0.0%" in said and "b.py aa 0.0%" in said and "3 languages" in said
