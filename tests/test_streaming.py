"""Files that arrive again, change, and lose their text; a batch that fails half-way."""

import pytest
from pyspark.sql import functions as F

from lexloom.streaming import ingest


@pytest.fixture
def folders(spark, tmp_path):
    names = [f"{tmp_path}/{x}" for x in ("in", "out", "check")]

    def come(*files):
        rows = [(p, None if t is None else t if isinstance(t, bytes) else t.encode()) for p, t in files]
        spark.createDataFrame(rows, ingest.SOURCE_DDL).coalesce(1).write.mode("append").parquet(names[0])

    def run(**how):
        ingest.segments_stream(spark, *names, **how).awaitTermination()

    return come, run, names


def held(spark, target):
    return sorted((r.path, r.source_text) for r in ingest.current_segments(spark, target).collect())


def test_a_file_that_comes_twice_and_changes_once(spark, folders):
    come, run, (_, target, _) = folders
    come(("a.txt", "一\nx\n二"), ("b.md", "# 题\n`码`\n"), ("c.ts", 'x = "文"; fetch("路")'), ("d.txt", b"\xff\xfe"), ("e.txt", None))
    run()
    first = held(spark, target)
    assert first == [("a.txt", "一"), ("a.txt", "二"), ("b.md", "题"), ("c.ts", "文")]
    come(("a.txt", "一\nx\n二"), ("b.md", "# 题\n`码`\n"))  # the same again
    run()
    assert held(spark, target) == first and spark.read.parquet(f"{target}/files").count() == 4
    come(("a.txt", "三"), ("a.txt", "三"), ("b.md", "# plain\n"))  # one changes, one has nothing left
    run()
    assert held(spark, target) == [("a.txt", "三"), ("c.ts", "文")]
    assert spark.read.parquet(f"{target}/files").count() == 6 and spark.read.parquet(f"{target}/segments").count() == 5
    run()  # nothing new
    assert held(spark, target) == [("a.txt", "三"), ("c.ts", "文")]


def test_a_batch_that_fails_is_repeated_whole(spark, folders, monkeypatch):
    come, run, (_, target, _) = folders
    come(("a.txt", "一"), ("b.txt", "二"))
    whole = ingest.segments_of

    def broken(files):
        return whole(files).withColumn("line", F.when(F.col("path") == "b.txt", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("line")))

    monkeypatch.setattr(ingest, "segments_of", broken)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(ingest, "segments_of", whole)
    run()
    assert held(spark, target) == [("a.txt", "一"), ("b.txt", "二")] and spark.read.parquet(f"{target}/files").count() == 2


def test_state_with_a_bound(spark, folders):
    come, run, (_, target, _) = folders
    for text in ("一", "一", "二"):
        come(("a.txt", text))
        run(forget="10 days", files_per_batch=1)
    assert held(spark, target) == [("a.txt", "二")] and spark.read.parquet(f"{target}/files").count() == 2
