"""Importance resampling towards a target: documents whose word n-grams look like the target's are drawn more often.

Features are runs of one to three consecutive words; a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``.
Each task builds word tries of the stretches of text that it reads: a node is a feature, under the feature without its last word; it holds how often
it was met and the CRC state of its bytes, which is its parent's state carried over a space and one more word, so no
feature is ever written out as a string.  Counts of nodes are summed by bucket in the task and merged over all tasks (``BUCKETS`` numbers in
all).  The gain of a bucket is the log ratio of its share in the target and in the source; the second pass builds the tries again, attaches to each node
the gain of its bucket, and a document's weight is the sum of gains along the paths that its words walk.

A sample without replacement, in which weights act as log probabilities, are the rows of highest weight plus Gumbel noise;
the noise comes from a hash of the seed and doc_id, so a run can be repeated.  Ranks are given by ranges of (score, doc_id): rows are
numbered in each range and the sizes of the ranges before it are added, so no task sees all rows.

Memory: texts are read in stretches of about ``BLOCK_BYTES``; one that is longer is cut between words, and each
stretch sees the two words after it, so all its features are met and none twice.  A word of any length is held once.

Defined cases: null and empty texts have no features, weight 0, and are never drawn; very long texts are read whole;
repeated rows are scored alike, and drawn row by row; rows of equal score are in order of doc_id (nulls first, hashed as an
empty id); an empty source draws nothing, an empty target makes all gains those of a target without features; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.llm.common import BLOCK_BYTES, CRC_SQL, blocks, crc32_sql, staged

BUCKETS, ORDER = 10_000, 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Longer words carry CRC states byte by byte, others by tables.
TABLED = 64

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_APART = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_TWO_MORE = re.compile(rb"(?:[\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x60\x7B-\x7F]+){0,2}")


def _shifts() -> np.ndarray:
    """[n, j, b]: byte j of a CRC state, of value b, after n zero bytes; a state's bytes move independently."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    out = np.empty((TABLED + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, len(out)):
        out[n] = step[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


_SHIFTS = _shifts()


def stretches(text: str, limit: int = BLOCK_BYTES) -> list[tuple[bytes, int]]:
    """(bytes, how many are its own) of a lower-cased text, cut between words; what follows its own bytes are the next two words."""
    data = text.encode("utf-8", "surrogatepass").lower()
    out, at = [], 0
    while len(data) - at > limit:
        found = _APART.search(data, at + limit)
        cut = found.start() if found else len(data)
        out.append((data[at : _TWO_MORE.match(data, cut).end()], cut - at))
        at = cut
    return [*out, (data[at:], len(data) - at)]


class Trie:
    """The word trie of some stretches: for each level its nodes' ``counts`` and CRC ``states``, and the node of every own place.

    Level n has a node for each distinct run of n words; ``place`` tells which word each run begins with, ``node`` its node.
    """

    def __init__(self, parts: list[tuple[bytes, int]]):
        data = np.frombuffer(b" ".join(p for p, _ in parts) + b" ", np.uint8)
        begin = np.cumsum([0] + [len(p) + 1 for p, _ in parts])
        edge = np.flatnonzero(np.diff(np.concatenate(([False], _WORD[data], [False])).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        #: The stretch of each word, and whether the word is its own.
        self.part = np.searchsorted(begin, start, "right") - 1
        own = start - begin[self.part] < np.array([n for _, n in parts] or [0], np.int64)[self.part]
        ids, self.words = self._distinct(data, start, end)
        self.levels = []  # of (place, node, counts, states)
        place, node, states = np.flatnonzero(own), None, None
        for n in range(ORDER):
            place, node, states = self._level(n, place, node, states, ids)

    @staticmethod
    def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
        kept = data[_WORD[data]]
        found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()

    def _level(self, n: int, place: np.ndarray, node: np.ndarray | None, states: np.ndarray | None, ids: np.ndarray):
        """Nodes of runs one word longer than those of ``place``, whose nodes and states are given."""
        if not n:
            parent, word, node = None, np.arange(len(self.words)), ids[place]
            counts = np.bincount(node, minlength=len(self.words))
            self.sizes = np.array([len(w) + 1 for w in self.words], np.int64)
            self.spaced = np.array([zlib.crc32(b" " + w) for w in self.words], np.uint32)
            made = np.array([zlib.crc32(w) for w in self.words], np.uint32)
        else:
            inside = place + n < len(ids)
            inside[inside] = self.part[place[inside] + n] == self.part[place[inside]]
            place, node = place[inside], node[inside]
            keys, node, counts = np.unique(node * max(1, len(self.words)) + ids[place + n], return_inverse=True, return_counts=True)
            parent, word = np.divmod(keys, max(1, len(self.words)))
            made = self._carried(states[parent], word)
        self.levels.append((place, node, counts, made))
        return place, node, made

    def _carried(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """States after a space and a word: what came before is moved over as many zero bytes, then the word's own state is added."""
        size = self.sizes[word]
        n = np.minimum(size, TABLED + 1)
        out = self.spaced[word]
        for j in range(4):
            out = out ^ _SHIFTS[n, j, (state >> np.uint32(8 * j)) & np.uint32(255)]
        for k in np.flatnonzero(size > TABLED + 1):
            out[k] = zlib.crc32(b" " + self.words[word[k]], int(state[k]))
        return out

    def totals(self) -> np.ndarray:
        """Features of each bucket."""
        return sum(np.bincount(states % BUCKETS, counts, BUCKETS).astype(np.int64) for _, _, counts, states in self.levels)

    def walk(self, gains: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, features and the sum of gains of each stretch."""
        sums = np.zeros((3, parts))
        for n, (place, node, _, states) in enumerate(self.levels):
            of = self.part[place]
            met = np.bincount(of, minlength=parts)
            sums[0] += met if n == 0 else 0
            sums[1] += met
            sums[2] += np.bincount(of, gains[states % BUCKETS][node], parts)
        return tuple(sums.astype(np.int64))


def _blocks_of(texts: list):
    """(rows, stretches) of about BLOCK_BYTES together; a row is named once for each of its stretches."""
    for a, b in blocks(texts):
        if b - a > 1 or len(texts[a]) <= BLOCK_BYTES:
            parts = [(k, s) for k in range(a, b) for s in stretches(texts[k])]
            yield [k for k, _ in parts], [s for _, s in parts]
        else:
            for s in stretches(texts[a]):
                yield [a], [s]


def _texts(batch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def bucket_totals(docs: DataFrame) -> np.ndarray:
    """Features of each bucket over all rows; one row for each bucket reaches the driver."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, parts in _blocks_of(_texts(batch)):
                total += Trie(parts).totals()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target and in the source."""
    s, t, n, m = source.astype(float), target.astype(float), float(source.sum()), float(target.sum())
    return np.floor(1000 * np.log((t + 1) * (n + BUCKETS) / ((s + 1) * (m + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of ``docs``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(gains(bucket_totals(docs), bucket_totals(target)))
    given = docs.select("doc_id", "text")
    schema = StructType([given.schema["doc_id"], *StructType.fromDDL("n_words long, n_features long, weight long")])

    def score(batches):
        for batch in batches:
            texts = _texts(batch)
            sums = np.zeros((3, len(texts)), np.int64)
            for rows, parts in _blocks_of(texts):
                for k, values in enumerate(Trie(parts).walk(sent.value, len(parts))):
                    np.add.at(sums[k], rows, values)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], names=schema.names)

    return given.mapInArrow(score, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable, from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; ``percent`` of the rows of ``least_words`` words or more have a rank."""
    spark = docs.sparkSession
    scored = staged(weigh(docs, target).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "importance-scores")
    order = [F.desc("score"), F.asc("doc_id")]
    able = scored.filter(F.col("n_words") >= least_words)
    dealt = staged(able.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "importance-ranges")
    sizes = sorted(tuple(r) for r in dealt.groupBy("part").count().collect())  # a row for each range
    ends = np.cumsum([n for _, n in sizes]).tolist()
    drawn = (ends[-1] if ends else 0) * percent // 100
    offsets = spark.createDataFrame([(p, e - n) for (p, n), e in zip(sizes, ends)], "part int, earlier long")
    rank = F.col("earlier") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    numbered = dealt.join(F.broadcast(offsets), "part").withColumn("rank", rank)
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    other = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return numbered.select(*columns).unionByName(other.select(*columns))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The same rows with every feature written out.
SQL = rf"""WITH {CRC_SQL}, rows AS (SELECT 0 AS side, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
words AS (SELECT side, doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM rows),
runs AS (SELECT side, doc_id, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY side, doc_id ORDER BY k)),
f AS (SELECT side, doc_id, a AS feature FROM runs UNION ALL SELECT side, doc_id, a || ' ' || b FROM runs WHERE b IS NOT NULL UNION ALL SELECT side, doc_id, a || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL),
b AS (SELECT feature, {crc32_sql("feature")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM f), crc),
g AS (SELECT bucket, count_if(side = 0) AS s, count_if(side = 1) AS t FROM f JOIN b USING (feature) GROUP BY 1),
total AS (SELECT sum(s)::DOUBLE AS big_s, sum(t)::DOUBLE AS big_t FROM g),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (big_s + {BUCKETS}) / ((s + 1)::DOUBLE * (big_t + {BUCKETS}))))::BIGINT AS gain FROM g, total),
d AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN b USING (feature) JOIN gain USING (bucket) WHERE side = 0 GROUP BY 1),
scored AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM rows LEFT JOIN d USING (doc_id) WHERE side = 0),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * {PERCENT} // 100 AS drawn FROM scored WHERE words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END::BIGINT AS rank FROM scored LEFT JOIN able USING (doc_id)"""
