"""Shared plumbing: table access, Arrow batch walking, bounded text blocks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import wordhash

#: Bytes of the batches that Spark hands to Python workers (its own default is 64 MB, several times over in each worker).
ARROW_BYTES = 4 << 20
#: Texts are handed to numpy in blocks of about this many characters.
BLOCK_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of whole texts by their bytes, where the session has left them at the default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "64MB"):  # with a default of its own, get() doesn't tell Spark's
        spark.conf.set(key, f"{ARROW_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the Parquet tables; only Spark touches the path, so any store works."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, as the session names it.

    Where the session names none, a local master gets a folder of its own machine; a cluster gets an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or f"/tmp/lexloom-shared-{os.getuid()}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of what runs in it at its end, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def staged(df: DataFrame, label: str, drop_shuffles: bool = False) -> DataFrame:
    """Write a table into the shared folder and read it back, so its lineage ends there; with ``drop_shuffles`` its shuffle files go at once."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark) if drop_shuffles else contextlib.nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_tables: dict[str, dict] = {}


def worker_tables(owner: str) -> dict:
    """What a worker keeps for the tasks of one module; it is emptied when a task of another module begins there."""
    return _tables.setdefault(owner, {})


def released(run: Callable[[Iterator], Iterator], owner: str | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow: tables of other modules' tasks are dropped first, and at its end what the task has freed goes back to the system.

    Workers stay for the tasks of later stages, and would hold what the earlier ones needed.
    """
    owner = run.__module__ if owner is None else owner

    def work(batches):
        for name, held in _tables.items():
            if name != owner:
                held.clear()
        yield from run(batches)
        wordhash.forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return work


def blocks(texts: list, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about ``limit`` characters; a longer text is a block of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text)
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def per_document(
    docs: DataFrame, columns: list[str], schema: str, work: Callable[[dict[str, list]], dict[str, list]]
) -> DataFrame:
    """Map blocks of documents (``columns`` only, as Python lists) to columns of ``schema``.

    Nulls in ``text`` arrive as empty strings; one row in, any number of rows out.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        for batch in batches:
            rows = {c: batch.column(c).to_pylist() for c in columns}
            texts = rows["text"] = [t or "" for t in rows["text"]]
            for a, b in blocks(texts):
                out = work({c: v[a:b] for c, v in rows.items()})
                yield pa.RecordBatch.from_arrays([_array(out[n], n, types) for n in names], names=names)

    types: dict[str, pa.DataType] = {}
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in list(kinds.items())}
    for part in schema.split(","):
        name, kind = part.split()
        types[name] = kinds[kind]
    return docs.select(*columns).mapInArrow(released(run, work.__module__), schema)


def _array(values, name: str, types: dict[str, pa.DataType]) -> pa.Array:
    return pa.array(values, type=types[name])


#: DuckDB: one row with the 256 remainders of CRC-32, and the CRC-32 of a string's UTF-8 bytes where that row is joined.
CRC_SQL = """crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc_table FROM range(256) r(i))"""


def crc32_sql(text: str) -> str:
    octets = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: ('0x' || hex({text})[i:i + 1])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, o: xor(c >> 8, crc_table[(xor(c, o) & 255) + 1])), 4294967295)"
