"""File trees, tables as files, JSON-lines manifests and the translation memory."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom import fixed_values as V
from lexloom.functions import text as T
from lexloom.operators.translate import staged
from lexloom.sources.versions import Versions, read_table, write_table

MEMORY_DDL = "translation_key string, source_text string, target_text string, kind string, hits long"


#: Entries of one Arrow batch, and bytes of contents of one.
ENTRIES, BYTES = 10_000, 8 << 20
#: Bytes of contents that one task reads, about.
TASK_BYTES = 64 << 20
_ENTRY = "path string, length long, is_symlink boolean, link_target string, is_folder boolean"


def _entries(root: str, folder: str) -> Iterator[tuple]:
    """What a folder holds, in no order; a link is an entry of its own, wherever it points."""
    base = os.path.join(root, folder) if folder else root
    with os.scandir(base) as held:
        for e in held:
            name = f"{folder}/{e.name}" if folder else e.name
            link = e.is_symlink()
            yield name, e.stat(follow_symlinks=False).st_size, link, os.readlink(e.path) if link else None, not link and e.is_dir(follow_symlinks=False)


def _batches(rows: Iterator[tuple], schema: str, most: int) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [(n, kinds[k]) for n, k in (part.split() for part in schema.split(", "))]
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held), fields)], names=[n for n, _ in fields])


def list_tree(spark: SparkSession, root: str, skipped: Sequence[str] = (), stage: Callable[[DataFrame], DataFrame] = staged) -> DataFrame:
    """path, length, is_symlink and link_target of all files and links below ``root``, a folder that all executors reach.

    The frontier of folders is a table that tasks expand level by level, so the driver knows how many folders are left but no names.
    Folders whose name is ``skipped`` are not entered.  A root that is missing has no files.
    """
    top = os.path.abspath(root)

    def expand(batches):
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                if folder or os.path.isdir(top):
                    yield from _batches(_entries(top, folder), _ENTRY, ENTRIES)

    levels: list[DataFrame] = []
    frontier = spark.createDataFrame([("",)], "path string")
    while True:
        level = stage(frontier.mapInArrow(expand, _ENTRY))
        levels.append(level.filter("not is_folder").drop("is_folder"))
        frontier = level.filter("is_folder").select("path")
        if skipped:
            frontier = frontier.filter(~F.element_at(F.split("path", "/"), -1).isin(*skipped))
        left = frontier.count()
        if not left:
            return reduce(DataFrame.unionByName, levels)
        frontier = frontier.repartition(min(left, 4 * spark.sparkContext.defaultParallelism))


def read_contents(listed: DataFrame, root: str) -> DataFrame:
    """``listed`` rows (see :func:`list_tree`) with the content of files; links have none.

    Names are dealt to tasks of about TASK_BYTES by their hash, however folders are filled.
    """
    top = os.path.abspath(root)
    schema = "path string, content binary, length long, is_symlink boolean, link_target string"
    total = listed.agg(F.coalesce(F.sum(F.when(~F.col("is_symlink"), F.col("length"))), F.lit(0)).alias("n")).first().n

    def contents(rows):
        for path, size, link, target in rows:
            if link:
                yield path, None, size, link, target
            else:
                with open(os.path.join(top, path), "rb") as f:
                    yield path, f.read(), size, link, target

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("path", "length", "is_symlink", "link_target")))
            held, size = [], 0
            for row in contents(rows):
                held.append(row)
                size += row[2]
                if size >= BYTES:
                    yield from _batches(iter(held), schema, len(held))
                    held, size = [], 0
            if held:
                yield from _batches(iter(held), schema, len(held))

    tasks = max(int(total // TASK_BYTES) + 1, min(4 * listed.sparkSession.sparkContext.defaultParallelism, int(total >> 16) + 1))
    return listed.repartition(tasks, F.xxhash64("path")).mapInArrow(run, schema)


def read_tree(spark: SparkSession, root: str, snapshot: str = "source", with_content: bool = True, where: Column | None = None, skipped: Sequence[str] = ()) -> DataFrame:
    """Files and links of a tree (FILES_DDL).  ``where`` chooses by path, length and links before any content is read, and
    ``skipped`` folders are not listed.
    """
    listed = list_tree(spark, root, skipped)
    if where is not None:
        listed = listed.filter(where)
    files = read_contents(listed, root) if with_content else listed.withColumn("content", F.lit(None).cast("binary"))
    return files.select("path", "content", "length", "is_symlink", "link_target", F.lit(snapshot).alias("snapshot"))


def write_tree(files: DataFrame, root: str) -> None:
    """Writes each row as one file or link, by rename, so a reader sees the old or the new one.

    ``root`` must be a folder that all executors reach.
    """
    linked = "link_target" in files.columns

    def put(rows):
        for r in rows:
            full = os.path.join(root, r.path)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            part = f"{full}.{os.getpid()}.part"
            if linked and r.link_target is not None:
                os.symlink(r.link_target, part)
            else:
                with open(part, "wb") as f:
                    f.write(bytes(r.content))
                    f.flush()
                    os.fsync(f.fileno())
            os.replace(part, full)

    files.select("path", "content", *["link_target"] * linked).foreachPartition(put)


def documents_as_files(docs: DataFrame) -> DataFrame:
    """doc_id, path and src: the documents with two words made Chinese, under a folder for each language."""
    src = F.replace(F.replace("text", F.lit(" the "), F.lit(" 这个 ")), F.lit(" and "), F.lit(" 和 "))
    path = F.concat(F.lit("docs/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select("doc_id", "lang", path.alias("path"), src.alias("src"))


def manifest_lines(header: DataFrame, segments: DataFrame) -> DataFrame:
    """JSON lines in order: the header with the number of segments, then segments by path and place; nulls are written."""

    def row(df):
        return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})

    counted = header.join(F.broadcast(segments.agg(F.count("*").alias("segment_count"))))
    first = counted.select(F.lit("").alias("path"), F.lit(-1).cast("long").alias("start_byte"), row(counted).alias("value"))
    return first.unionByName(segments.select("path", "start_byte", row(segments).alias("value"))).orderBy("path", "start_byte").select("value")


def write_manifest(header: DataFrame, segments: DataFrame, path: str) -> None:
    """A manifest as the next version of ``path``: a folder of JSON-lines files, whose names keep the order."""
    Versions(segments.sparkSession, path).write(lambda folder: manifest_lines(header, segments).write.text(folder))


def _lines_of(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block and id of every line; ids rise by one within a block, which is a part of a file that one task reads."""
    versions = Versions(spark, path)
    where = versions.current()[1] if versions.exists() else path
    read = spark.read.text(where, lineSep="\n")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return read.select("value", *place).withColumn("id", F.monotonically_increasing_id())


def numbered(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows``, some of ``lines``, with their ``line`` in their file, from 1: the lines of blocks before, and the place within the block.

    Only counts of blocks are put in order.
    """
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", "first", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    told = rows.join(blocks, ["file", "block"])
    return told.withColumn("line", (F.col("earlier") + F.col("id") - F.col("first") + 1).cast("long")).drop("block", "id", "first", "earlier")


#: Fields of a segment that a line may lack.
OPTIONAL = ("target_text", "context_before", "context_after", "protected_context")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header lines, segments, faulty lines) of a JSON-lines manifest; a row is a line, and files are read in parts.

    Faulty lines (file, line, value, reason) have other fields than a segment, or break a row constraint; only they are numbered.
    Blank lines are passed over.
    """
    lines = _lines_of(spark, path)
    filled = lines.filter(F.trim("value") != "")
    names = [f.split()[0].strip("`") for f in V.SEGMENT_DDL.split(", ")]
    keys = F.json_object_keys("value")
    head = F.coalesce(F.get_json_object("value", "$.type") == "header", F.lit(False))
    known = F.size(F.array_except(keys, F.array(*map(F.lit, names)))) == 0
    whole = F.size(F.array_except(F.array(*[F.lit(n) for n in names if n not in OPTIONAL]), keys)) == 0
    well = F.coalesce(known & whole, F.lit(False))
    rows = filled.filter(~head).withColumn("s", F.when(well, F.from_json("value", V.SEGMENT_DDL)))
    fault = rows.select("value", "file", "block", F.col("id").alias("place"), "s", "s.*")
    fault = fault.withColumn("reason", F.when(F.col("s").isNull(), "fields").otherwise(T.segment_fault()))
    segments = fault.filter("reason is null").select("s.*")
    bad = fault.filter("reason is not null").select("value", "file", "block", F.col("place").alias("id"), "reason")
    return filled.filter(head).select("value"), segments, numbered(bad, lines).select("file", "line", "value", "reason")


def rewrite_targets(spark: SparkSession, path: str, targets: DataFrame) -> int:
    """The next version of a manifest, with new targets (id, target_text) put in; all other lines stay byte for byte.

    Without targets nothing is written.  The number of the current version is returned.
    """
    versions = Versions(spark, path)
    base, folder = versions.current()
    if folder is None or targets.limit(1).count() == 0:
        return base
    part = lambda name: F.get_json_object("value", f"$.{name}")
    lines = spark.read.text(folder, lineSep="\n").filter(F.trim("value") != "")
    keyed = lines.select("value", part("id").alias("id"), F.coalesce(part("path"), F.lit("")).alias("path"), F.coalesce(part("start_byte").cast("long"), F.lit(-1)).alias("start_byte"))
    new = F.to_json(F.from_json("value", V.SEGMENT_DDL).withField("target_text", F.col("target_text")), {"ignoreNullFields": "false"})
    told = keyed.join(targets.select("id", "target_text", F.lit(True).alias("told")), "id", "left")
    out = told.select("path", "start_byte", F.when(F.col("told"), new).otherwise(F.col("value")).alias("value"))
    return versions.write(lambda where: out.orderBy("path", "start_byte").select("value").write.text(where), base)


def read_memory(spark: SparkSession, path: str | None) -> DataFrame:
    """The memory from a table (Parquet) or one JSON document (``.json``); nothing where there is none, an error that names a faulty file."""
    nothing = spark.createDataFrame([], MEMORY_DDL)
    if not path:
        return nothing
    if not path.endswith(".json") and Versions(spark, path).exists():
        return read_table(spark, path, MEMORY_DDL)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return nothing
    if not path.endswith(".json"):
        return spark.read.schema(MEMORY_DDL).parquet(path)
    entry = "entries map<string, struct<translation_key: string, source_text: string, target_text: string, kind: string, hits: long>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", entry, {"mode": "PERMISSIVE"}).alias("m"), F.get_json_object("value", "$.entries").isNotNull().alias("well"))
    if whole.filter("not well or m.entries is null").limit(1).count():
        raise ValueError(f"{path} is not a translation memory")
    return whole.select(F.explode("m.entries").alias("k", "e")).select("e.*")


def write_memory(memory: DataFrame, path: str) -> None:
    """Entries with a target, as the next version of a table (Parquet), or as one JSON document where the path ends so (for memories of one machine)."""
    kept = memory.filter("target_text is not null")
    if not path.endswith(".json"):
        write_table(kept, path)
        return
    entry = F.struct(*[f.split()[0] for f in MEMORY_DDL.split(", ")])
    rows = kept.select(F.to_json(F.struct(F.col("translation_key").alias("k"), entry.alias("e"))).alias("j")).orderBy("j").toLocalIterator()
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write('{"version": 1, "entries": {')
        for n, r in enumerate(rows):
            held = json.loads(r.j)
            f.write((",\n" if n else "\n") + json.dumps(held["k"]) + ": " + json.dumps(held["e"], ensure_ascii=False))
        f.write("\n}}\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.part", path)
