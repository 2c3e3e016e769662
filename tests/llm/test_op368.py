import random

import numpy as np

from lexloom.llm import op3_language_id as o3
from lexloom.llm import op6_quality as o6
from lexloom.llm import op8_decontaminate as o8
from lexloom.llm.common import table


def test_suffix_automaton_accepts_exactly_the_substrings():
    rng = np.random.default_rng(2)
    passages = [rng.integers(1, 4, 40).tolist() for _ in range(4)]
    made = o3.SuffixAutomaton([s for p in passages for s in [*p, 0]])
    inside = {tuple(p[i:j]) for p in passages for i in range(40) for j in range(i, 41)}
    for _ in range(3000):
        word = tuple(rng.integers(1, 4, rng.integers(1, 7)).tolist())
        state = 0
        for s in word:
            state = made.next[state].get(s, -1) if state >= 0 else -1
        assert (state >= 0) == (word in inside)


def test_phrases_equal_a_greedy_parse():
    samples = {"a": ["the cat sat on the mat"], "b": ["der hund sass auf der matte", "und schlief"]}
    made = o3.Identifier(samples)
    corpora = {k: [o3.letters(p) for p in v] for k, v in samples.items()}
    for text in ("the hat der Matte", "xyz", "", "on the", "und und, der cat"):
        clean = " ".join(o3.letters(text).split(" "))
        while "  " in clean:
            clean = clean.replace("  ", " ")
        for column, name in enumerate(made.names):
            at = n = 0
            while at < len(clean):
                size = 1
                while at + size < len(clean) and any(clean[at : at + size + 1] in p for p in corpora[name]):
                    size += 1
                at, n = at + size, n + 1
            assert made.phrases([text])[0, column] == n, (text, name)


def test_long_texts_are_parsed_as_wholes(monkeypatch):
    rng = random.Random(11)
    words = ["the", "cat", "sat", "on", "mat", "hund", "matte", "schlief", "xq"]
    made = o3.Identifier({"a": [" ".join(rng.choices(words[:5], k=200))], "b": [" ".join(rng.choices(words[4:8], k=200))]})
    texts = [" ".join(rng.choices(words, k=n)) for n in (1, 90, 400, 3000)] + ["the " * 5000, "q" * 3000, ""]
    cut = made.phrases(texts)
    monkeypatch.setattr(o3, "STRETCH", 1 << 30)
    assert (made.phrases(texts) == cut).all()


def test_language_accuracy_and_cases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r for r in o3.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in rows if rows[i].held_out]
    assert len(rows) == len(truth) and np.mean([rows[i].lang_pred == truth[i] for i in held]) >= 0.95
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 !", "en"), (3, "the", None), (3, "the", None), (4, "häuser " * 100_000, "de")], "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in o3.identify(odd).collect())
    assert got[0][1:] == ("und", 0.0) and got[1][1:] == ("und", 0.0) and got[2] == got[3]
    assert o3.identify(odd.limit(0)).collect() == []


def test_quality_finds_toxic_words_and_keeps_clean_text(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = " ".join(rng.choices(words, k=rng.randint(20, 80)))
        kind = 0 if i % 10 == 0 else 1 if i % 10 == 1 else 2
        if kind == 0:
            text += " awful insult"
        if kind == 1:
            text = text.replace(" ", "!!! ").upper()
        rows.append((i, text, "k"))
        if i % 3:
            labels.append((i, int(kind == 2), int(kind == 0)))
    rows += [(5000, None, "k"), (5001, "", "k"), (5002, "word1 " * 200_000, "k"), (7, rows[7][1], "k")]
    labels += [(5000, None, None), (3, 1, 0), (3, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in o6.score(docs, rated).collect()}
    wrong = [i for i in range(900) if i % 3 == 0 and out[i].keep != (i % 10 > 1)]
    assert len(wrong) <= 15 and not any(i % 10 == 0 for i in wrong)
    kept = o6.select(docs, rated)
    assert kept.columns == docs.columns and kept.count() == sum(out[r[0]].keep for r in rows)
    assert all(0 <= out[i].p_toxic <= 1 and 0 <= out[i].expected_grade <= 2 for i in out)
    assert o6.score(docs, rated.limit(0)).filter("not keep").count() == 0
    assert o6.score(docs.limit(0), rated).collect() == []


def distance(a, b):
    """Smallest edit distance of a to any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


def test_matches_equal_brute_force_distance():
    rng = random.Random(9)
    letters = "ab cde"
    items = [(k, "".join(rng.choices(letters, k=rng.randint(20, 60)))) for k in range(6)] + [(6, None), (7, " "), (8, "tiny")]
    items.append((9, items[0][1]))
    matcher = o8.Matcher(items, 15)
    for _ in range(120):
        text = "".join(rng.choices(letters, k=50))
        k, item = items[rng.randrange(6)]
        copy = list(item)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(["", "x", "yz"])
        text = o8.normal(text + "".join(copy) + text)
        want = {}
        for i, t in items:
            t = o8.normal(t)
            if t and (d := distance(t, text)) <= len(t) * 15 // 100:
                want[i] = d
        got = {i: d for i, d, a, b in matcher.find(text)}
        assert got == want
        for i, d, a, b in matcher.find(text):
            t = o8.normal(dict(items)[i])
            assert distance(t, text[a:b]) == d


def test_blocks_of_items_together_find_what_one_block_finds(spark, sf_dir, monkeypatch):
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    again = docs.limit(5)  # repeated rows are reported for each
    docs = docs.unionByName(again)
    one, kept = sorted(o8.leaks(docs, items).collect()), sorted(r.doc_id for r in o8.clean(docs, items).collect())
    monkeypatch.setattr(o8, "ITEM_CHARS", 2_500)
    assert len(list(o8._blocks(items))) > 2
    assert sorted(o8.leaks(docs, items).collect()) == one and sorted(r.doc_id for r in o8.clean(docs, items).collect()) == kept


def test_leaks_and_clean(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: o8.normal(r.text) for r in docs.collect()}
    exact = {(i, r.item_id) for r in items.collect() for i, t in texts.items() if o8.normal(r.text) in t}
    found = o8.leaks(docs, items).collect()
    assert exact and exact <= {(r.doc_id, r.item_id) for r in found}
    assert all(r.distance == 0 for r in found if (r.doc_id, r.item_id) in exact)
    kept = o8.clean(docs, items)
    assert {r.doc_id for r in kept.collect()} == set(texts) - {r.doc_id for r in found} and kept.columns == docs.columns
    odd = spark.createDataFrame([(1, None, 3), (2, "", 3)], "doc_id long, text string, item_id int")
    assert o8.leaks(odd, items).collect() == [] and o8.clean(odd, items).count() == 2
    assert o8.leaks(docs, items.limit(0)).collect() == [] and o8.clean(docs, items.limit(0)).count() == len(texts)
