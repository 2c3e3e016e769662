import numpy as np

from lexloom.llm import op6_quality as op


def tables(spark):
    base = set(op.features([""])[0].tolist())

    def bucket(word):
        return max(set(op.features([word])[0].tolist()) - base)

    insult = next(w for w in (f"q{k}" for k in range(1000)) if bucket(w) > op.BUCKETS * 0.95)
    words = [f"word{k}" for k in range(6000)]
    rows = [(i, " ".join(words[i % 7 :: 2] + ([insult] if i % 2 else []))) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels, bucket(insult)


def test_long_texts_teach_all_their_features(spark):
    rows, docs, labels, at = tables(spark)
    assert min(op.features([t for _, t in rows])[1]) > 2048
    weights, _ = op.learn(docs, labels)
    assert weights[at] < -0.1


def test_the_bound_leaves_out_whole_rows(spark, monkeypatch):
    rows, docs, labels, _ = tables(spark)
    column, counts = op.features([t for _, t in rows])
    whole = {p.tobytes() for p in np.split(column, np.cumsum(counts)[:-1])}
    monkeypatch.setattr(op, "MAX_FEATURES", int(counts.sum()) // 2)
    monkeypatch.setattr(op, "fit", lambda found: found)
    found = op.learn(docs, labels)
    assert 0 < len(found) < len(rows) and all(f.tobytes() in whole for _, f in found)
    assert sum(len(f) for _, f in found) <= op.MAX_FEATURES


def test_one_row_of_equal_ids_counts(spark, monkeypatch):
    rows = [(1, "a few words here"), (1, "a few words here and some more of them"), (2, "bad")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(op, "fit", lambda found: found)
    for parts in (1, 7):
        found = op.learn(docs.repartition(parts), labels)
        column, counts = op.features(["bad", "a few words here"])
        assert [(g, f.tolist()) for g, f in found] == [(1, column[: counts[0]].tolist()), (2, column[counts[0] :].tolist())]
