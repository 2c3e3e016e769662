"""What bounds the memory of a Python worker and of the JVM that feeds it."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from lexloom.llm import common, op6_quality
from lexloom.llm.bpe_core import Machine, Vocabulary

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_whole_texts_are_bounded_in_a_session_that_sets_nothing(spark):
    session = spark.newSession()
    common.small_batches(session)
    docs = session.range(0, 3_000, 1, 1).select(F.repeat(F.lit("text "), 1_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    got = docs.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 3_000
    assert max(r.size for r in got) < common.ARROW_BYTES * 1.25  # before, all 15 MB came in one


def test_a_bound_that_the_session_sets_stays(spark):
    session = spark.newSession()
    session.conf.set(KEY, "1m")
    common.small_batches(session)
    assert session.conf.get(KEY) == "1m"


def test_states_of_the_encoder_take_little_memory():
    rng = np.random.Generator(np.random.PCG64(1))
    machine = Machine(Vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    symbols = rng.integers(97, 123, 60_000).astype(np.int16)
    lengths = np.full(6_000, 10)
    starts = np.arange(6_000) * 10
    symbols[starts + 9] += 256
    machine.run(symbols[:10], starts[:1], lengths[:1], keep=True)
    tracemalloc.start()
    try:
        machine.run(symbols, starts, lengths, keep=True)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held / len(machine.states) < 380  # before, 498 bytes


def test_texts_of_the_classifier_are_hashed_in_short_blocks(monkeypatch, spark):
    sizes = []
    monkeypatch.setattr(op6_quality, "learn", lambda *a: (np.zeros(op6_quality.BUCKETS), np.array([-1.0, 1.0])))
    monkeypatch.setattr(op6_quality, "tails", lambda texts, *a: sizes.append(sum(map(len, texts))) or np.ones((len(texts), 2)))
    monkeypatch.setattr(op6_quality, "released", lambda run: run)

    class Docs:
        sparkSession, schema = spark, None

        def mapInArrow(self, run, schema):
            return list(run([pa.RecordBatch.from_pydict({"text": ["x" * 100_000] * 20 + [None]})]))

    (out,) = op6_quality.select(Docs(), None)
    assert out.num_rows == 21 and sum(sizes) == 2_000_000 and max(sizes) <= 1 << 18
