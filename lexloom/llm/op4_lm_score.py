"""LM scoring with a log-frequency Bloom filter.

Training documents give counts of one- and two-grams.  A count ``c`` is quantised to level ``floor(log2 c)``;
the filter holds the pair (n-gram, j) for every level ``j`` from 0 that it reached.  Asking for levels 0, 1, ... until
one is missing gives the level back; ``1.5 * 2**level`` stands for the count from level 1, and 1 for level 0.

N-grams travel as packed integers of five bytes in buckets (bucket and bytes make 52 bits or more of the hash), so
counting them moves about five bytes a distinct n-gram of a chunk of texts.  The filter is blocked: an n-gram's bits all
lie in one block of ``BLOCK_BITS``, and blocks are stretches of buckets.  The filter is never gathered: the task that
counts a bucket fills its blocks, asks them for all n-grams that chunks sent, and sends the levels back to the chunks,
where texts are scored.  So the filter has ``BITS_PER_TOKEN`` bits a training token at any size of the input.

The probability of a word after a history interpolates orders on the add-0.1 unigram probability of the filter:
``p_n = SHARE * min(c(hw), c(h)) / c(h) + (1 - SHARE) * p_(n-1)``, and ``p_(n-1)`` after an unknown history.

The base score needs exact counts.  The most frequent tokens (a fixed number) are broadcast; other tokens
of a document are joined with the count table, which is exact at any size.

Defined cases: a null or empty text has one token, its end; repeated rows are scored row by row and all of them
count for training; an empty table gives an empty table; without training rows N and V are 0 and every token is
unknown; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import blocks, discard, released, staged
from lexloom.llm.wordhash import mix, words

ORDER, SHARE, PROBES = 2, 0.5, 4
BLOCK_BITS, BITS_PER_TOKEN = 1 << 13, 4
#: Training tokens a bucket of n-grams, about, and the fewest buckets.
BUCKET_TOKENS, MIN_BUCKETS = 1 << 20, 1 << 12
#: Distinct tokens, in fours, that a task gathers before it hands them on.
GATHER = 1 << 20
#: Characters of the texts that are counted and scored together; a longer text is a chunk of its own.
CHUNK_CHARS = 8 << 20
#: Levels of 64-bit counts.
TOP = 63
#: Most frequent tokens whose exact counts are broadcast, and the longest of them in bytes.
FREQUENT, FREQUENT_BYTES = 50_000, 48
END = np.uint64(0x5851F42D4C957F2D)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rest array<struct<token:binary,n:long>>"


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 10 == 0 if doc_id is not None else False


def tokens(text: str | None) -> list[bytes]:
    """Words of the lower-cased text; the end token is left to the caller."""
    return (text or "").encode().lower().split()


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For orders 1 to ORDER the n-gram hash that ends at each token (0 where the text is too short), and tokens a text."""
    hashes, counts = words(texts)
    sizes = counts + 1
    ends = np.cumsum(sizes)
    seq = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    last = np.zeros(len(seq), bool)
    last[ends - 1] = True
    seq[last], seq[~last] = END, hashes
    place = np.arange(len(seq)) - np.repeat(ends - sizes, sizes)
    out = [mix(seq, 1)]
    for n in range(2, ORDER + 1):
        longer = np.zeros(len(seq), np.uint64)
        if len(seq) > 1:
            longer[1:] = mix(out[-1][:-1] + seq[1:], n)
        longer[place < n - 1] = 0
        out.append(longer)
    return out, sizes


def _chunks(batches):
    """Rows of about ``CHUNK_CHARS`` characters, packed; rows of several batches stand in one chunk, as batches are smaller."""
    held, size = [], 0
    for batch in batches:
        batch = batch.select(["doc_id", "text"])
        for lo, hi in blocks([t or "" for t in batch.column("text").to_pylist()], CHUNK_CHARS):
            part = batch.slice(lo, hi - lo)
            n = pc.sum(pc.utf8_length(part.column("text"))).as_py() or 0
            if held and size + n > CHUNK_CHARS:
                yield _packed(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield _packed(held)


def _packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for part in parts:
            writer.write_batch(part)
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["body"])


def _unpack(body: bytes) -> tuple[list, list[str]]:
    rows = pa.ipc.open_stream(body).read_all()
    return rows["doc_id"].to_pylist(), [t or "" for t in rows["text"].to_pylist()]


def _chunk_grams(ids: list, texts: list[str], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a chunk, sorted, and how often each is met in its training texts."""
    every, kept_out = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for lo, hi in blocks(texts):
        found, sizes = grams(texts[lo:hi])
        out = np.repeat(np.array([held_out(i) for i in ids[lo:hi]], bool), sizes)
        for g in found:
            every.append(narrow(g[g != 0], n_buckets))
            kept_out.append(narrow(g[(g != 0) & out], n_buckets))
    every = np.sort(np.concatenate(every))
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    gram = every[first]
    counts = np.diff(first, append=len(every))
    return gram, counts - np.bincount(np.searchsorted(gram, np.concatenate(kept_out)), minlength=len(gram))


def _train(n_buckets: int):
    """(bucket, chunk, packed n-grams, their training counts where they are not one) of all n-grams of chunks."""

    def run(batches):
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
                # sorted by hash, so buckets (the leading bits) are stretches
                gram, counts = _chunk_grams(*_unpack(body.as_buffer()), n_buckets)
                bucket = (gram >> np.uint64(64 - n_buckets.bit_length() + 1)).astype(np.int64)
                cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
                rest = np.ascontiguousarray(gram << np.uint64(n_buckets.bit_length() - 1)).view(np.uint8).reshape(-1, 8)[:, 3:]
                rows = np.flatnonzero(np.diff(cut))
                more = [np.flatnonzero(counts[cut[r] : cut[r + 1]] != 1).astype(np.int32) for r in rows]
                for k in range(0, len(rows), 2048):
                    some = list(zip(rows[k : k + 2048].tolist(), more[k : k + 2048]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r for r, _ in some], pa.int64()),
                            pa.array([chunk] * len(some), pa.int64()),
                            pa.array([rest[cut[r] : cut[r + 1]].tobytes() for r, _ in some], pa.binary()),
                            pa.array([m.tobytes() for _, m in some], pa.binary()),
                            pa.array([counts[cut[r] : cut[r + 1]][m].astype(np.int32).tobytes() for r, m in some], pa.binary()),
                        ],
                        names=["bucket", "chunk", "grams", "at", "n"],
                    )

    return run


def narrow(gram: np.ndarray, n_buckets: int) -> np.ndarray:
    """The hash without the bits that do not travel (all but the bucket's and the 40 after them)."""
    drop = np.uint64(max(0, 24 - n_buckets.bit_length() + 1))
    return gram >> drop << drop


def _count_tokens(batches):
    """(token, count) of training texts; the end token is null."""
    counts: Counter = Counter()

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    for batch in batches:
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if not held_out(i):
                counts.update(tokens(text))
                counts[None] += 1
        if len(counts) > GATHER // 4:
            yield flush()
            counts = Counter()
    if counts:
        yield flush()


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1] - 1  # floor(log2 c)


def positions(gram: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """Bit positions inside the n-gram's block, one array a probe."""
    h = mix(gram + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 77)
    return [((h >> np.uint64(13 * k)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for k in range(PROBES)]


def block_of(gram: np.ndarray, n_blocks: int) -> np.ndarray:
    """Blocks by the leading bits of the hash, as buckets are."""
    return (gram >> np.uint64(64 - n_blocks.bit_length() + 1)).astype(np.int64) if n_blocks > 1 else np.zeros(len(gram), np.int64)


def _counts(n_buckets: int, bucket: int, rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole bucket, their training counts, and the place of each n-gram of the rows among them."""
    rest, counts = [], []
    for grams_, at, n in rows:
        packed = np.zeros((len(grams_) // 5, 8), np.uint8)
        packed[:, 3:] = np.frombuffer(grams_, np.uint8).reshape(-1, 5)
        rest.append(packed.view(np.uint64)[:, 0])
        count = np.ones(len(packed), np.int64)
        count[np.frombuffer(at, np.int32)] = np.frombuffer(n, np.int32)
        counts.append(count)
    rest, counts = np.concatenate(rest), np.concatenate(counts)
    order = np.argsort(rest, kind="stable")
    rest = rest[order]
    new = np.concatenate(([True], rest[1:] != rest[:-1]))
    first = np.flatnonzero(new)
    place = np.empty(len(rest), np.int64)
    place[order] = np.cumsum(new) - 1
    shift = np.uint64(n_buckets.bit_length() - 1)
    gram = (rest[first] >> shift) | (np.uint64(bucket) << (np.uint64(64) - shift))
    return gram, np.add.reduceat(counts[order], first), place


def _insert(gram: np.ndarray, counts: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Block and bits in it of each sorted n-gram and level, and the top level."""
    gram, counts = gram[counts > 0], counts[counts > 0]
    top = levels(counts) + 1
    repeated = np.repeat(np.arange(len(gram)), top)
    level = np.arange(len(repeated)) - np.repeat(np.cumsum(top) - top, top)
    return block_of(gram, n_blocks)[repeated], np.stack(positions(gram[repeated], level)), int(top.max(initial=0)) - 1


def probe(bits: np.ndarray, base: np.ndarray, gram: np.ndarray, top: int) -> np.ndarray:
    """The level of each n-gram whose block begins at bit ``base``, -1 where it is missing; no level above ``top`` is asked for."""
    level = np.full(len(gram), -1, np.int64)
    live = np.flatnonzero(gram != 0)
    for step in range(top + 1):
        if not live.size:
            break
        held = np.ones(live.size, bool)
        for at in positions(gram[live], np.full(live.size, step)):
            at = at + base[live]
            held &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        live = live[held]
        level[live] = step
    return level


def estimate(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for."""
    return np.where(level > 0, 1.5 * 2.0**level, level + 1.0)


def _by_bucket(batches):
    """(bucket, its chunks, its rows) from rows that arrive sorted by bucket."""
    now, chunks, rows = None, [], []
    for batch in batches:
        for bucket, chunk, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "grams", "at", "n"))):
            if bucket != now:
                if rows:
                    yield now, chunks, rows
                now, chunks, rows = bucket, [], []
            chunks.append(chunk)
            rows.append(row)
    if rows:
        yield now, chunks, rows


def _answer(n_buckets: int, n_blocks: int):
    """(chunk, bucket, levels of the chunk's n-grams in the bucket) from packed n-grams; a bucket has whole blocks."""

    def run(batches):
        out, size = [], 0
        for bucket, chunks, rows in _by_bucket(batches):
            gram, counts, place = _counts(n_buckets, bucket, rows)
            block, at, top = _insert(gram, counts, n_blocks)
            start, here = bucket * (n_blocks // n_buckets), n_blocks // n_buckets
            cells = np.zeros(here * BLOCK_BITS, bool)
            cells[((block - start) * BLOCK_BITS + at).ravel()] = True
            found = probe(np.packbits(cells, bitorder="little"), (block_of(gram, n_blocks) - start) * BLOCK_BITS, gram, top)
            code = found.astype(np.int8)[place]
            for chunk, part in zip(chunks, np.split(code, np.cumsum([len(r[0]) // 5 for r in rows])[:-1])):
                out.append((chunk, bucket, part.tobytes()))
                size += len(part)
            if size > 4 * GATHER or len(out) > 1 << 14:
                yield _answers(out)
                out, size = [], 0
        if out:
            yield _answers(out)

    return run


def _answers(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    chunk, bucket, body = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(bucket, pa.int64()), pa.array(body, pa.binary())], names=["chunk", "bucket", "body"])


def _fill(n_buckets: int, n_blocks: int):
    """(block, bits) from the packed n-grams of whole buckets, which arrive sorted by bucket."""

    def run(batches):
        out = []
        for bucket, _, rows in _by_bucket(batches):
            block, bits, _ = _insert(*_counts(n_buckets, bucket, rows)[:2], n_blocks)
            ids, begin = np.unique(block, return_index=True)  # sorted by n-gram, so blocks are stretches
            for b, part in zip(ids.tolist(), np.split(bits, begin[1:], axis=1)):
                cells = np.zeros(BLOCK_BITS, bool)
                cells[part.ravel()] = True
                out.append((b, np.packbits(cells, bitorder="little").tobytes()))
            if len(out) > 2048:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["block", "bits"])


def _rows_of(batches):
    for batch in batches:
        yield from zip(batch.column("chunk").to_pylist(), batch.column("body").to_pylist())


def _join_blocks(batches):
    """The union of all parts of each block, where a block has several buckets."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, bits in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
            part = np.frombuffer(bits, np.uint8)
            held[block] = held[block] | part if block in held else part
    if held:
        yield _rows([(b, x.tobytes()) for b, x in held.items()])


def shape(tokens_: int) -> tuple[int, int]:
    """Blocks and buckets for so many training tokens."""
    n_blocks = max(1, (1 << math.ceil(math.log2(max(1, tokens_ * BITS_PER_TOKEN)))) // BLOCK_BITS)
    return n_blocks, max(MIN_BUCKETS, 1 << math.ceil(math.log2(max(1, tokens_ * ORDER / BUCKET_TOKENS))))


def packed_grams(chunks: DataFrame, n_buckets: int) -> DataFrame:
    """Packed n-grams of all chunks, each bucket whole in one task."""
    packed = chunks.mapInArrow(released(_train(n_buckets)), "bucket long, chunk long, grams binary, at binary, n binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket")


def chunked(rows: DataFrame) -> DataFrame:
    """``rows`` in numbered chunks, written down so that the numbers stay."""
    return staged(rows.mapInArrow(released(_chunks), "body binary").select(F.monotonically_increasing_id().alias("chunk"), "body"), "lm-chunks")


def build_filter(rows: DataFrame, tokens_: int) -> tuple[np.ndarray, int]:
    """The whole filter's bytes and the number of buckets: for filters of a size for one machine; scoring gathers none."""
    n_blocks, n_buckets = shape(tokens_)
    filled = packed_grams(chunked(rows), n_buckets).mapInArrow(_fill(n_buckets, n_blocks), "block long, bits binary")
    if n_buckets > n_blocks:
        filled = filled.repartition("block").mapInArrow(_join_blocks, "block long, bits binary")
    table = filled.toArrow()
    out = np.zeros((n_blocks, BLOCK_BITS // 8), np.uint8)
    for block, bits in zip(table["block"].to_pylist(), table["bits"]):
        out[block] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.ravel(), n_buckets


class Model:
    """Reads a whole filter."""

    def __init__(self, bits: np.ndarray, n_buckets: int, total: int, distinct: int):
        self.bits, self.n_buckets, self.total, self.distinct = bits, n_buckets, total, distinct
        self.n_blocks = len(bits) * 8 // BLOCK_BITS

    def levels(self, gram: np.ndarray) -> np.ndarray:
        gram = narrow(gram, self.n_buckets)
        return probe(self.bits, block_of(gram, self.n_blocks) * BLOCK_BITS, gram, TOP)

    def count(self, gram: np.ndarray) -> np.ndarray:
        """Counts of n-grams above one as the filter has them."""
        level = self.levels(gram)
        return np.where(level > 0, estimate(level), 0.0)


def text_scores(texts: list[str], known: np.ndarray, level: np.ndarray, n_buckets: int, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability and tokens of each text, from the levels of the sorted n-grams ``known``."""
    found, sizes = grams(texts)
    counts = []
    for g in found:
        some, back = np.unique(narrow(g, n_buckets), return_inverse=True)
        at = np.minimum(np.searchsorted(known, some), len(known) - 1)
        counts.append(np.where(some == 0, 0.0, estimate(level[at]))[back])
    p = (counts[0] + 0.1) / (max(total, 1) + 0.1 * (distinct + 1))
    for n in range(1, ORDER):
        history = np.zeros(len(p))
        history[1:] = counts[n - 1][:-1]
        history[found[n] == 0] = 0
        p = np.where(history > 0, SHARE * np.minimum(counts[n], history) / np.maximum(history, 1.0) + (1 - SHARE) * p, p)
    text = np.repeat(np.arange(len(texts)), sizes)
    return np.bincount(text, np.log10(np.minimum(p, 1.0)), len(texts)), sizes


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    counted = staged(rows.mapInArrow(released(_count_tokens), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "lm-tokens", drop_shuffles=True)
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    short = counted.filter(F.octet_length("token") <= FREQUENT_BYTES)
    top = short.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    end = counted.filter("token is null").agg(F.sum("n")).first()[0] or 0
    n_blocks, n_buckets = shape(total)
    n_blocks = max(n_blocks, n_buckets)  # a bucket has whole blocks
    below = total + 0.1 * (distinct + 1)
    frequent = spark.sparkContext.broadcast(dict(zip(top["token"].to_pylist(), top["n"].to_pylist())))

    def score(batches):
        known_counts = frequent.value
        logs = {t: math.log10((c + 0.1) / below) for t, c in known_counts.items()}
        end_log, n_end = math.log10((end + 0.1) / below), int(end > 0)
        # of each chunk first the texts (bucket -1), then the levels by bucket, which is the order of the sorted n-grams
        for _, parts in groupby(_rows_of(batches), key=lambda r: r[0]):
            ids, texts = _unpack(next(parts)[1])
            gram = _chunk_grams(ids, texts, n_buckets)[0]
            level = np.frombuffer(b"".join(p for _, p in parts), np.int8).astype(np.int64)
            if len(level) != len(gram):
                raise ValueError(f"{len(level)} levels of {len(gram)} n-grams")
            for lo, hi in blocks(texts):
                value, sizes = text_scores(texts[lo:hi], gram, level, n_buckets, total, distinct)
                known, base, rest = [], [], []
                for text in texts[lo:hi]:
                    own, sure, out, others = end_log, n_end, Counter(tokens(text)), []
                    for t, c in out.items():
                        log = logs.get(t)
                        if log is None:
                            others.append({"token": t, "n": c})
                        else:
                            own += c * log
                            sure += c
                    known.append(sure)
                    base.append(own)
                    rest.append(others)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo:hi], pa.int64()), pa.array([held_out(i) for i in ids[lo:hi]]), pa.array(sizes, pa.int64()),
                        pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(value, pa.float64()),
                        pa.array(rest, pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "rest"],
                )

    chunks = chunked(rows)
    answers = packed_grams(chunks, n_buckets).mapInArrow(released(_answer(n_buckets, n_blocks)), "chunk long, bucket long, body binary")
    both = answers.unionByName(chunks.select("chunk", F.lit(-1).cast("long").alias("bucket"), "body"))
    met = both.repartition("chunk").sortWithinPartitions("chunk", "bucket")
    first = staged(met.mapInArrow(released(score), SCHEMA).withColumn("row", F.monotonically_increasing_id()), "lm-scores", drop_shuffles=True)
    discard(chunks)
    rare = first.select("row", F.inline("rest"))
    joined = rare.join(counted.withColumnRenamed("n", "c"), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.1) / below)).alias("more_base"),
    )
    return first.drop("rest").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
