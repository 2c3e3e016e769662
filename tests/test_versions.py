"""Versions with an atomic pointer, and manifests read in parts."""

import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import extract
from lexloom.sources import files as S
from lexloom.sources.versions import Conflict, Versions, read_table, write_table


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x int")


def seen(spark, root):
    return sorted(r.x for r in read_table(spark, root, "x int").collect())


def test_readers_see_whole_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert read_table(spark, root, "x int") is None and Versions(spark, root).current() == (0, None)
    assert write_table(table(spark, 1, 2), root) == 1
    old = read_table(spark, root, "x int")

    def broken(folder):
        table(spark, 8).write.parquet(folder)
        raise OSError("lost")

    with pytest.raises(OSError):
        Versions(spark, root).write(broken)
    failing = table(spark, 1, 2, 3).withColumn("x", F.when(F.col("x") == 3, F.raise_error(F.lit("bad")).cast("int")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="bad"):
        write_table(failing, root)
    assert seen(spark, root) == [1, 2]
    assert write_table(table(spark, 3), root) == 2
    assert seen(spark, root) == [3] and sorted(r.x for r in old.collect()) == [1, 2]  # a reader keeps what it began with
    assert Versions(spark, root).vacuum(keep=1) == 3 and seen(spark, root) == [3]


def test_of_two_writers_one_fails(spark, tmp_path):
    root = str(tmp_path / "t")
    write_table(table(spark, 1), root)
    store = Versions(spark, root)

    def change(folder):
        rows = spark.read.parquet(folder)
        write_table(table(spark, 7), root)  # another writer comes in between
        return lambda where: rows.write.parquet(where)

    with pytest.raises(Conflict):
        store.update(change)
    assert seen(spark, root) == [7]
    assert store.update(lambda folder: lambda where: spark.read.parquet(folder).withColumn("x", F.col("x") + 1).write.parquet(where)) == 3
    assert seen(spark, root) == [8]


def segments(spark, n):
    rows = [(f"d/{k % 7}.txt", "string", 10 * k, 10 * k + 5, f"文本 {k} \"x\"") for k in range(n)]
    made = extract.build_segments(spark.createDataFrame(rows, extract.SPAN)).withColumns({"line": F.lit(1), "column": F.lit(0), "file_sha256": F.lit("f"), "context_before": F.lit(""), "context_after": F.lit(""), "protected_context": F.lit(None).cast("array<string>")})
    return made.select(*[f.split()[0].strip("`") for f in S.V.SEGMENT_DDL.split(", ")])


def test_manifest_is_rewritten_line_by_line(spark, tmp_path):
    path = str(tmp_path / "m")
    header = spark.createDataFrame([("header", 1)], "type string, version int")
    S.write_manifest(header, segments(spark, 50), path)
    lines = lambda: [r.value for r in spark.read.text(Versions(spark, path).current()[1], lineSep="\n").collect()]
    before = lines()
    assert json.loads(before[0])["segment_count"] == 50 and len(before) == 51
    assert S.rewrite_targets(spark, path, spark.createDataFrame([], "id string, target_text string")) == 1
    ids = [json.loads(x)["id"] for x in before[1:]]
    new = spark.createDataFrame([(ids[3], 'target "q"'), (ids[9], ""), ("unknown", "x")], "id string, target_text string")
    assert S.rewrite_targets(spark, path, new) == 2
    after = lines()
    changed = [k for k, (a, b) in enumerate(zip(before, after)) if a != b]
    assert len(after) == 51 and changed == [4, 10]
    assert json.loads(after[4]) == json.loads(before[4]) | {"target_text": 'target "q"'} and json.loads(after[10])["target_text"] == ""


def test_a_large_file_is_read_in_parts(spark, tmp_path):
    """Many blocks of one file: rows are lines, and faulty ones have the numbers they have in the file."""
    made = [r.asDict(recursive=True) for r in segments(spark, 400).collect()]
    lines, want = ['{"type": "header"}'], {}
    for k, row in enumerate(made):
        if k % 50 == 7:
            lines.append("")
        fault = {11: ("fields", {"more": 1}), 23: ("range", {"end_byte": 0}), 37: ("path", {"path": "../x"}), 41: ("kind", {"kind": "verse"}), 43: ("digest", {"source_text": "other"})}.get(k % 47)
        if fault:
            row = row | fault[1]
            want[len(lines) + 1] = fault[0]
        lines.append(json.dumps(row, ensure_ascii=False))
        if k % 47 == 13:
            want[len(lines)] = "fields"
            lines[-1] = lines[-1][:-9]
    (tmp_path / "m.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "8192b")
    try:
        header, good, bad = S.read_manifest(spark, str(tmp_path / "m.jsonl"))
        assert bad.rdd.getNumPartitions() > 5
        assert {r.line: r.reason for r in bad.collect()} == want
        assert good.count() == len(made) - len(want) and header.count() == 1
    finally:
        spark.conf.set(key, old)
