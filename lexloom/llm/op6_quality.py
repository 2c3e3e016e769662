"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

Ratings become grades: 0 toxic, 1 poor, 2 good.  One vector of hashed-text weights ``w`` is shared by all grades,
ordered thresholds ``t1 < t2`` part them: ``P(grade > k) = sigmoid(w.x - t_k)``.  Features are the distinct hashed
words and word beginnings, sign runs and capital runs of the whole text and a few binned shares, each present or not, so length does
not matter.  The expected grade and the tail probability ``P(grade = 2)`` select documents.

The fit uses a bounded sample: at most ``MAX_ROWS`` labelled documents, the first by hash of doc_id, and of these as many as have
``MAX_FEATURES`` features together; each counts with all its features, and of rows with equal doc_id the one with the fewest (ties: the
smallest in bytes).  Features of fewer than ``MIN_DOCS`` rows have
weight 0.

Defined cases: a null or empty text has only the binned features; several labels of a document count by the
lowest grade, labels with nulls do not count; without usable labels all documents are kept with tail probability
1; repeated rows are scored row by row; an empty table gives an empty table; other columns are ignored (``score``)
or stay (``select``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import blocks, discard, per_document, released, staged
from lexloom.llm.wordhash import distinct, mix, runs

BUCKETS = 1 << 18
MAX_ROWS, MAX_FEATURES, MIN_DOCS = 12_000, 12_000 * 2_048, 4
#: Bytes of word beginnings that are features too.
HEADS = (4, 6)
GRADES, STEPS, RATE, DECAY = 3, 250, 0.1, 3e-4
THRESHOLD = 0.5
#: Characters of texts that are hashed at once.
TEXT_BLOCK = 1 << 18
#: Features that the fit works on at a time.
STRETCH = 1 << 20
SCHEMA = "doc_id long, p_toxic double, tail_prob double, expected_grade double, keep boolean"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SIGN = ~_LETTER
_SIGN[[0x20, *range(9, 14)]] = False


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, one after another, and how many each has."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    keys, shares = [], []

    def put(text, hashes):
        keys.append(distinct(text * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64)))

    for kind, (inside, lower) in enumerate(((_LETTER, True), (_SIGN, False), (_CAPITAL, False))):
        hashes, counts, sizes, *heads = runs(texts, inside, lower, HEADS if kind == 0 else ())
        text = np.repeat(np.arange(len(texts)), counts)
        if kind == 2:  # capital runs count by length only, up to 4
            hashes = np.minimum(sizes, 4).astype(np.uint64)
        put(text, mix(hashes, 300 + kind))
        shares.append(np.bincount(text, sizes, len(texts)))
        if kind == 0:
            for size, head in zip(HEADS, heads):
                put(text[sizes > size], head[sizes > size])
            words, kinds = counts, np.bincount(keys[0] // BUCKETS, minlength=len(texts))
    letters, signs, capitals = shares
    binned = (np.log2(n + 1).astype(np.int64) // 2, signs * 20 // (n + 1), capitals * 20 // (letters + 1), letters * 2 // (words + 1), kinds * 10 // (words + 1))
    for k, value in enumerate(binned):
        put(np.arange(len(texts)), mix(value.astype(np.int64).astype(np.uint64), 400 + k))
    every = distinct(np.concatenate(keys))
    return (every % BUCKETS).astype(np.int32), np.bincount(every // BUCKETS, minlength=len(texts))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of (grade, features), by Adam on the penalised likelihood of all rows."""
    if not rows:
        return np.zeros(BUCKETS), np.array([-40.0] * (GRADES - 1))
    packed = _packed(rows)
    del rows  # a list that only this call holds is free before the fit begins
    return _fit(*packed)


def _packed(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Grades, the buckets that count, and the row and place (among those) of each feature, in 32 bits."""
    grade = np.array([g for g, _ in rows])
    times = np.zeros(BUCKETS, np.int32)
    for _, found in rows:
        times[found] += 1  # each bucket once a row
    common = times >= min(MIN_DOCS, len(rows))
    used = np.flatnonzero(common)
    place = np.cumsum(common, dtype=np.int32) - 1
    parts = [place[found[common[found]]] for _, found in rows]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in parts])
    column = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return grade, used, row, column


def _fit(grade: np.ndarray, used: np.ndarray, row: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weights = np.zeros(BUCKETS)
    stretches = [slice(k, k + STRETCH) for k in range(0, len(row), STRETCH)]
    above = np.array([np.clip((grade > k).mean(), 0.01, 0.99) for k in range(GRADES - 1)])
    # free parameters: the weights, the first threshold, and logarithms of the gaps to the next ones
    start = -np.log(above / (1 - above))
    x = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    first, second = np.zeros_like(x), np.zeros_like(x)
    n = len(grade)
    for step in range(1, STEPS + 1):
        w, cut = x[: len(used)], np.cumsum(np.concatenate([x[len(used) : len(used) + 1], np.exp(x[len(used) + 1 :])]))
        f = sum((np.bincount(row[k], w[column[k]], n) for k in stretches), np.zeros(n))
        upper = np.concatenate([np.ones((n, 1)), _sigmoid(f[:, None] - cut)], axis=1)  # P(grade >= k)
        lower = np.concatenate([upper[:, 1:], np.zeros((n, 1))], axis=1)
        at = np.arange(n), grade
        p = np.maximum(upper[at] - lower[at], 1e-9)
        du, dl = upper[at] * (1 - upper[at]) / p, lower[at] * (1 - lower[at]) / p
        slope = np.zeros((n, GRADES + 1))  # of the log-likelihood in each bound
        slope[at] -= du
        slope[np.arange(n), grade + 1] += dl
        by_cut = slope[:, 1:GRADES].sum(axis=0)
        gap = np.exp(x[len(used) + 1 :])
        tail = np.cumsum(by_cut[::-1])[::-1]
        by_weight = sum((np.bincount(column[k], (du - dl)[row[k]], len(used)) for k in stretches), np.zeros(len(used)))
        gradient = np.concatenate([by_weight, tail[:1], tail[1:] * gap]) / n
        gradient[: len(used)] -= DECAY * w
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        x += RATE * (1 - step / (STEPS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    weights[used] = x[: len(used)]
    return weights, np.cumsum(np.concatenate([x[len(used) : len(used) + 1], np.exp(x[len(used) + 1 :])]))


def tails(texts: list[str], weights: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) of each text (rows) for each k (columns)."""
    column, counts = features(texts)
    f = np.bincount(np.repeat(np.arange(len(texts)), counts), weights[column], len(texts))
    return _sigmoid(f[:, None] - thresholds)


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from a bounded sample of the labelled documents."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rated = labels.select("doc_id", "quality", "toxic").na.drop().groupBy("doc_id").agg(F.min(grade).cast("long").alias("grade"))
    place = F.xxhash64("doc_id", F.lit("ratings"))
    chosen = rated.orderBy(place, "doc_id").limit(MAX_ROWS).withColumn("place", place)

    def emit(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in blocks(texts, TEXT_BLOCK):
                column, counts = features(texts[lo:hi])
                parts = [p.tobytes() for p in np.split(column, np.cumsum(counts)[:-1])]
                kept = [batch.column(c).slice(lo, hi - lo) for c in ("grade", "place")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(parts, pa.binary())], names=["grade", "place", "n", "found"])

    # the sample has a fixed bound, so it is the side to send
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "grade", "place")
    made = sample.mapInArrow(released(emit), "grade long, place long, n long, found binary")
    one = made.groupBy("place").agg(F.min(F.struct("n", "found", "grade")).alias("least")).select("place", "least.*")
    made = made_all = staged(one, "quality-sample")
    sizes = sorted(tuple(r) for r in made.select("place", "n").collect())
    fits = max(1, int((np.cumsum([n for _, n in sizes]) <= MAX_FEATURES).sum()))  # whole rows only
    if len(sizes) > fits:
        made = made.filter(F.col("place") <= sizes[fits - 1][0])
    return fit(_collected(made, made_all))


def _collected(made: DataFrame, whole: DataFrame) -> list[tuple[int, np.ndarray]]:
    """The sampled rows in a defined order; their staged table goes."""
    got = made.select("grade", "found").toArrow()
    discard(whole)
    rows = [(g, np.frombuffer(f.as_buffer(), np.int32)) for g, f in zip(got["grade"].to_pylist(), got["found"])]
    return sorted(rows, key=lambda r: (r[0], xxhash.xxh3_64_intdigest(r[1])))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_toxic, tail_prob, expected_grade, keep of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def work(rows):
        p = tails(rows["text"], *sent.value)
        return {"doc_id": rows["doc_id"], "p_toxic": 1 - p[:, 0], "tail_prob": p[:, -1], "expected_grade": p.sum(axis=1), "keep": p[:, -1] >= THRESHOLD}

    return per_document(docs, ["doc_id", "text"], SCHEMA, work)


def select(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose tail probability reaches ``threshold``; all columns stay, nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def keep(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            kept = [tails(texts[lo:hi], *sent.value)[:, -1] >= threshold for lo, hi in blocks(texts, TEXT_BLOCK)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(released(keep), docs.schema)
