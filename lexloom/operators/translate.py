"""Filling in translations: memory probe, one request a key, batches of an external provider, fan-out."""

from __future__ import annotations

import tempfile
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import accumulate
from typing import Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T


class Provider(Protocol):
    """An external function: as many texts out as in, in order.  Must be safe to repeat (tasks are retried)."""

    def translate(self, texts: Sequence[str]) -> Sequence[str]: ...


class Offline:
    """A provider made of a plain function; identity, upper case and dictionaries are such."""

    def __init__(self, work: Callable[[str], str]):
        self.work = work

    def translate(self, texts: Sequence[str]) -> list[str]:
        return [self.work(t) for t in texts]


class Dictionary(Offline):
    def __init__(self, words: dict[str, str]):
        def replace(text: str) -> str:
            for a, b in words.items():
                text = text.replace(a, b)
            return text

        super().__init__(replace)


class RoundRobin:
    """Deals texts to several providers in turn, asks them side by side and puts the answers back in order."""

    def __init__(self, providers: Sequence[Provider]):
        self.providers = list(providers)

    def translate(self, texts: Sequence[str]) -> list[str]:
        n = len(self.providers)
        out: list[str] = [""] * len(texts)
        with ThreadPoolExecutor(n) as pool:
            answers = list(pool.map(lambda k: list(self.providers[k].translate(texts[k::n])) if texts[k::n] else [], range(n)))
        for k, told in enumerate(answers):
            if len(told) != len(texts[k::n]):
                raise ValueError(f"provider answered {len(told)} of {len(texts[k::n])} texts")
            out[k::n] = told
        return out


class Pace:
    """Keeps requests ``interval`` seconds apart or more; the first waits ``offset`` seconds.  Clocks are those of the task."""

    def __init__(self, interval: float = 0.0, offset: float = 0.0):
        self.interval, self.offset, self.next = interval, offset, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"next": None}

    def wait(self) -> None:
        now = time.monotonic()
        at = now + self.offset if self.next is None else self.next
        if now < at:
            time.sleep(at - now)
        self.next = max(now, at) + self.interval


class Http:
    """JSON over HTTP: ``encode`` makes a request body of texts, ``decode`` reads the answers; ``pace`` is kept between requests."""

    def __init__(self, url: str, encode: Callable, decode: Callable, headers: dict | None = None, per_request: int = 50, pace: Pace | None = None, timeout: float = 60.0):
        self.url, self.encode, self.decode, self.headers = url, encode, decode, headers or {}
        self.per_request, self.pace, self.timeout = per_request, pace or Pace(), timeout

    def translate(self, texts: Sequence[str]) -> list[str]:
        import json
        import urllib.request

        out: list[str] = []
        for k in range(0, len(texts), self.per_request):
            body = json.dumps(self.encode(list(texts[k : k + self.per_request]))).encode()
            request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"} | self.headers)
            self.pace.wait()
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                out += self.decode(json.load(answer))
        return out


@dataclass
class Engine:
    """A service that ``lanes`` tasks ask at once, together at most ``rate`` requests a second (none: as fast as it answers).

    ``make`` gives a lane its provider, which keeps the lane's share of the rate.
    """

    make: Callable[[Pace], Provider]
    lanes: int = 1
    rate: float | None = None

    def lane(self, k: int) -> Provider:
        interval = self.lanes / self.rate if self.rate else 0.0
        return self.make(Pace(interval, k * interval / self.lanes))


class Lanes:
    """Several engines with their lanes; a lane is one task, so a rate holds for the cluster, however many executors it has."""

    def __init__(self, engines: Sequence[Engine]):
        self.all = [(e, k) for e in engines for k in range(e.lanes)]
        if not self.all:
            raise ValueError("no lane to deal texts to")

    def __len__(self) -> int:
        return len(self.all)

    def __getitem__(self, lane: int) -> Provider:
        engine, k = self.all[lane]
        return engine.lane(k)


def _twice(provider: Provider, texts: list[str]) -> list[str]:
    """The answers of one request or, where it fails or they don't fit, of a second one."""
    for attempt in (1, 2):
        try:
            got = list(provider.translate(texts))
            if len(got) != len(texts):
                raise ValueError(f"provider answered {len(got)} of {len(texts)} texts")
            return got
        except Exception:
            if attempt == 2:
                raise
    raise AssertionError


def call(provider: Provider, texts: Sequence[str], on_error: str = "raise") -> list[str]:
    """As many answers as texts; blank ones are not sent.

    A call that fails is repeated once; then each text is asked by itself, with one more try, so that a bad one does not take the
    others with it.  What fails alone raises, or stays as it is with ``on_error='passthrough'``.
    """
    ask = [i for i, t in enumerate(texts) if t.strip()]
    out = list(texts)
    if not ask:
        return out
    try:
        for i, t in zip(ask, _twice(provider, [texts[i] for i in ask])):
            out[i] = t
        return out
    except Exception:
        if len(ask) == 1 and on_error == "raise":
            raise
    for i in ask if len(ask) > 1 else ():
        try:
            out[i] = _twice(provider, [texts[i]])[0]
        except Exception:
            if on_error == "raise":
                raise
    return out


def provide(keys: DataFrame, provider: Provider | Lanes, batch_size: int = 40, with_calls: bool = False, on_error: str = "raise") -> DataFrame:
    """(translation_key, target_text) for (translation_key, source_text); protected tokens pass untouched.

    Gaps between protected tokens of up to ``batch_size`` texts are one call; batches are made in each
    partition, so no row number over the whole table is needed.  ``with_calls`` adds the number of the call that
    answered, null where there was nothing but blanks to ask.  With :class:`Lanes`, keys are dealt to lanes by their hash, and
    each lane is a partition of its own.
    """
    gaps, found = T.protected_split(F.col("source_text"))
    ready = keys.select("translation_key", gaps.alias("gaps"), found.alias("found"))
    lanes = provider if isinstance(provider, Lanes) else None
    if lanes is not None:
        ready = ready.repartitionById(len(lanes), F.pmod(F.xxhash64("translation_key"), F.lit(len(lanes))).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        number, asked_of = place << 33, provider if lanes is None else lanes[place]
        for batch in batches:
            for k in range(0, batch.num_rows, batch_size):
                part = batch.slice(k, batch_size)
                gaps_, found_ = part.column("gaps").to_pylist(), part.column("found").to_pylist()
                asked = [g for row in gaps_ for g in row]
                told = iter(call(asked_of, asked, on_error))
                texts = []
                for row, kept in zip(gaps_, found_):
                    new = [next(told) for _ in row]
                    texts.append("".join(a + b for a, b in zip(new, [*kept, ""])))
                number += 1
                calls = pa.array([number if any(map(str.strip, asked)) else None] * part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("translation_key"), pa.array(texts, pa.string()), calls], names=["translation_key", "target_text", "call"])

    out = ready.mapInArrow(run, "translation_key string, target_text string, call long")
    return out if with_calls else out.drop("call")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which the driver and all executors share.

    Where the session names none, a local master gets one of its own machine; a cluster gets an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, so that what made it runs once."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def distinct_keys(segments: DataFrame, order: str = "id") -> DataFrame:
    """One row a key, with the text of its first segment; partial aggregation keeps hot keys small."""
    return segments.groupBy("translation_key").agg(F.min_by(F.struct("source_text", "kind"), order).alias("s"), F.count("*").alias("n")).select("translation_key", "s.*", "n")


@dataclass
class Translation:
    """What a run over a manifest gives: segments with targets, the new memory, and one row of statistics."""

    segments: DataFrame
    memory: DataFrame
    statistics: DataFrame


def translate_manifest(segments: DataFrame, memory: DataFrame, provider: Provider, stage: Callable[[DataFrame], DataFrame] = staged, batch_size: int = 40) -> Translation:
    """Fills the segments without a target: from the memory, else each key once by the provider.

    ``stage`` must write a table and read it back: a provider is called once, whatever is retried later.  Segments that
    have a target keep it, so a second run asks for nothing; hits of the memory grow by each segment that it filled.
    """
    missing = segments.filter("target_text is null")
    misses = distinct_keys(missing).join(memory.select("translation_key"), "translation_key", "left_anti")
    fresh = stage(provide(misses, provider, batch_size, with_calls=True))
    known = memory.select("translation_key", F.col("target_text").alias("found"), F.lit("memory").alias("origin"))
    known = known.unionByName(fresh.select("translation_key", F.col("target_text").alias("found"), F.lit("provider").alias("origin")))
    joined = segments.join(known, "translation_key", "left").withColumn("origin", F.when(F.col("target_text").isNull(), F.col("origin")))
    filled = joined.withColumn("target_text", F.coalesce("target_text", "found")).drop("found", "origin")
    hits = missing.groupBy("translation_key").agg(F.count("*").alias("more"))
    old = memory.join(hits, "translation_key", "left").withColumn("hits", F.col("hits") + F.coalesce("more", F.lit(0))).drop("more")
    added = misses.join(fresh, "translation_key").select("translation_key", "source_text", "target_text", "kind", F.lit(0).cast("long").alias("hits"))
    counted = joined.agg(
        F.count("*").alias("segments_total"), F.count_if(F.coalesce("target_text", "found").isNotNull()).alias("segments_translated"),
        F.count_if(F.col("origin") == "memory").alias("segments_from_memory"), F.count_if(F.col("origin") == "provider").alias("segments_from_provider"),
    )
    calls = fresh.agg(F.count_distinct("call").alias("provider_calls"))  # one row each
    return Translation(filled, old.unionByName(added), counted.join(F.broadcast(calls)))


def update_targets(segments: DataFrame, targets: DataFrame) -> DataFrame:
    """New targets by id; other rows stay as they are."""
    return segments.join(targets.select("id", F.col("target_text").alias("new")), "id", "left").withColumn("target_text", F.coalesce("new", "target_text")).drop("new")


def batches(rows: DataFrame, order: str | list[str], size: int, engines: int, stage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Ordinal, batch and engine of each row in one global order (a report; calls use :func:`provide`).

    Rows are dealt by ranges, numbered in each range, and the ranges' counts (one row each) are added up.
    """
    # the upper bits of the id are the range's number, the lower ones the row's place in it
    keys = [order] if isinstance(order, str) else order
    dealt = (stage or staged)(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = sorted((r.part, r.n) for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = dict(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0)))
    offsets = rows.sparkSession.createDataFrame(list(before.items()), "_part long, _before long")
    numbered = dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    ordinal = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    out = numbered.withColumn("ordinal", ordinal.cast("int")).drop("_id", "_part", "_before")
    return out.withColumns({"batch": F.floor(F.col("ordinal") / size), "engine": F.pmod("ordinal", F.lit(engines))})
