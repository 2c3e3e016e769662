import math
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lexloom.llm import op4_lm_score as op
from lexloom.llm.common import table


def brute(rows):
    split = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    counts = Counter()
    for i, words in split:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(words)
    total, below = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    out = {}
    for i, words in split:
        base = sum(math.log10((counts[w] + 0.1) / below) for w in words)
        out[i] = (zlib.crc32(str(i).encode()) % 10 == 0, len(words), sum(counts[w] > 0 for w in words), total, base)
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = op.score_documents(docs).collect()
    want = brute(rows)
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    return got


def test_whole_table_and_rare_tokens(spark, sf_dir, monkeypatch):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    monkeypatch.setattr(op, "FREQUENT", 50)
    got = check(spark, rows)
    held = [r for r in got if r.held_out and r.n_tokens > 50]
    # held-out texts are better predicted than by the base, and those that training knows much better
    gain = [(r.score - r.base_score) / r.n_tokens for r in held]
    assert np.mean(gain) > 0.3 and np.median(gain) > 0
    assert np.median([(r.score - r.base_score) / r.n_tokens for r in got if not r.held_out and r.n_tokens > 50]) > 0.5


def test_defined_cases(spark):
    check(spark, [(1, None), (2, ""), (3, " \n"), (5, "A b a " * 50_000), (8, "new words"), (9, "é É x")])
    same = spark.createDataFrame([(4, "a b zz"), (4, "a b zz")], "doc_id long, text string")
    a, b = op.score_documents(same).collect()
    assert a == b and a.n_tokens == 4
    assert op.score_documents(same.limit(0)).collect() == []


def test_filter_gives_levels_back(spark, monkeypatch):
    monkeypatch.setattr(op, "BITS_PER_TOKEN", 32)
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(rng.choice([f"w{k}" for k in range(200)], 400, p=np.arange(200, 0, -1) / 20100))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    train = [t.encode().split() + [None] for i, t in texts if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(x for words in train for x in zip(words, words[1:]))
    for buckets in (1 << 4, 1 << 12):  # fewer and more buckets than blocks
        monkeypatch.setattr(op, "MIN_BUCKETS", buckets)
        bits, n_buckets = op.build_filter(docs, sum(map(len, train)))
        model = op.Model(bits, n_buckets, 1, 1)
        got, want = [], []
        for (a, b), c in counts.items():
            if b is not None:
                gram = op.grams([f"{a.decode()} {b.decode()}"])[0][1][1:2]
                got.append(model.count(gram)[0])
                want.append(1.5 * 2.0 ** np.floor(np.log2(c)) if c > 1 else 0.0)
        got, want = np.array(got), np.array(want)
        assert (got >= want).all() and (got == want).mean() > 0.97


def test_scores_use_single_counts_and_a_filter_that_grows(spark):
    assert op.shape(1 << 36)[0] * op.BLOCK_BITS == op.BITS_PER_TOKEN << 36  # 64 billion tokens keep their bits
    words = [f"w{k}" for k in range(40)]
    texts = [(i, " ".join(words[(i * 7 + k * (i % 3 + 1)) % 40] for k in range(12))) for i in range(1, 60)]
    texts.append((1001, "alpha beta gamma"))  # every pair is met once
    train = [(t or "").encode().split() + [None] for i, t in texts if not op.held_out(i)]
    one, two = Counter(w for t in train for w in t), Counter(x for t in train for x in zip(t, t[1:]))

    def about(c):
        return 1.5 * 2.0 ** math.floor(math.log2(c)) if c > 1 else float(c)

    below = sum(one.values()) + 0.1 * (len(one) + 1)
    got = {r.doc_id: r.score for r in op.score_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    assert not op.held_out(1001)
    for i, t in texts:
        seq, want = t.encode().split() + [None], 0.0
        for k, w in enumerate(seq):
            p, h = (about(one[w]) + 0.1) / below, about(one[seq[k - 1]]) if k else 0.0
            both = min(about(two[seq[k - 1], w]) if k else 0.0, h)
            want += math.log10(min(op.SHARE * both / h + (1 - op.SHARE) * p if h else p, 1.0))
        assert got[i] == pytest.approx(want, rel=1e-9), i


def test_probe_of_a_full_filter_ends():
    full = np.full(op.BLOCK_BITS // 8, 255, np.uint8)
    assert op.probe(full, np.zeros(2, np.int64), np.array([5, 0], np.uint64), 3).tolist() == [3, -1]


def test_disk_is_freed_before_the_result_is_read(spark):
    def held():
        """Bytes of shuffle files by name."""
        files, out = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator(), {}
        while files.hasNext():
            file = files.next()
            if file.getName().startswith("shuffle_") and file.getName().endswith(".data"):
                out[file.getName()] = file.length()
        return out

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before, chunks = set(held()), set(folder.glob("lm-chunks-*"))
    more = lambda: sum(size for name, size in held().items() if name not in before)
    rows = [(i, f"one two {i} three {i}x") for i in range(1000)]
    scored = op.score_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert set(folder.glob("lm-chunks-*")) <= chunks
    # files go in the background; rows of the few totals may stay
    until = time.monotonic() + 10
    while more() > 4096 and time.monotonic() < until:
        time.sleep(0.2)
    assert more() <= 4096
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None  # as it was
    assert scored.count() == 1000
