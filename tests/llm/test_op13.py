"""Importance resampling against features written out as strings, and against SQL on the whole table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lexloom.llm import op13_importance as op
from lexloom.llm.queries import op13_importance_query

UPPER = {c: c + 32 for c in range(65, 91)}
NAMES = ["doc_id", "n_features", "weight", "score", "rank"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def features(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)))
    for text in target:
        t.update(map(bucket, features(text)))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000))))
    out = []
    for doc_id, text in docs:
        own = features(text)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for place, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = place
    return sorted(tuple(r[:5]) for r in out)


def found(df):
    assert df.columns == NAMES
    return sorted(tuple(r) for r in df.collect())


def made(seed, rows):
    r = random.Random(seed)
    vocabulary = ["Ab", "c1", "这个", "x" * 70, "é", "y" * 66, "of", "THE", "z" * 300, "😀"]
    sign = lambda: r.choice([" ", ", ", "-", "\n", "\x7f", "_"])
    return ["".join(r.choice(vocabulary) + sign() for _ in range(r.choice([0, 1, 2, 3, 25, 60]))) for _ in range(rows)]


def test_made_texts_in_small_stretches(spark):
    docs = list(enumerate([None, "", *made(1, 300)]))
    target = [None, *made(2, 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({"weight": F.lit("w"), "rank": F.lit("r"), "part": F.lit(3)})
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert found(op.resample(df, goal)) == brute(docs, target)


def test_stretches_see_every_feature_once():
    for text in made(3, 40):
        for limit in (1, 7, 50, 400):
            trie = op.Trie(op.stretches(text, limit))
            want = np.bincount([bucket(f) for f in features(text)], minlength=op.BUCKETS)
            assert (trie.totals() == want).all(), (limit, text)
            parts = len(op.stretches(text, limit))
            gains = np.arange(op.BUCKETS)
            n, f, w = (x.sum() for x in trie.walk(gains, parts))
            assert (n, f, w) == (len(words(text)), len(features(text)), int((want * gains).sum()))


def test_long_text(spark):
    long = "the quick brown fox jumps over 12 lazy dogs! " * 60_000 + "w" * 3_000_000 + " end"
    docs = [(1, long), (2, "short"), *((k, f"some text of twenty words or more {'again and ' * 8} {k}") for k in range(3, 50))]
    assert found(op.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("brown fox",)], "text string"))) == brute(docs, ["brown fox"])


def test_cases(spark):
    docs = spark.createDataFrame([(3, "a " * 30), (3, "a " * 30), (None, "b " * 30), (1, None)], "doc_id long, text string")
    none = docs.limit(0)
    rows = op.resample(docs, none, percent=100).collect()
    assert sorted(r.rank for r in rows if r.rank) == [1, 2, 3] and len({(r.weight, r.score) for r in rows if r.doc_id == 3}) == 1
    assert [(r.n_features, r.weight, r.rank) for r in rows if r.doc_id == 1] == [(0, 0, None)]
    assert op.resample(none, docs).collect() == []


def test_whole_table_against_sql(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = c.execute(f"SELECT {', '.join(NAMES)} FROM ({op.SQL})").fetchall()
    assert found(op13_importance_query(spark, sf_dir)) == sorted(want)
