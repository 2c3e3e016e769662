"""The interval anti join against all pairs, with groups that are cut into many ranges; parsers as table functions."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import extract, intervals, parsers


@pytest.mark.parametrize("seed", range(3))
def test_anti_join(spark, seed):
    rng = random.Random(seed)
    made = lambda n, longest: [(rng.choice(["hot"] * 6 + ["a", "b", "c"]), s := rng.randrange(500), s + rng.randint(0, longest)) for _ in range(n)]
    rows, covers = made(600, 20), made(40, 60) + [("a", 0, 500)] * (seed == 2) + [("b", 7, 7), ("c", 9, 3)]
    rows += [("none", 1, 2), (None, 1, 2), ("hot", None, 5), ("hot", 3, None)] + rows[:5]
    frames = [spark.createDataFrame(x, "path string, start_byte long, end_byte long") for x in (rows, covers)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = intervals.outside(frames[0].withColumn("_at", F.lit("x")), frames[1])
        assert got.columns == ["path", "start_byte", "end_byte", "_at"]
        got = sorted((tuple(r)[:3] for r in got.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hit = lambda r: any(None not in r and c[0] == r[0] and c[1] < c[2] and c[1] < r[2] and r[1] < c[2] for c in covers)
    assert got == sorted((r for r in rows if not hit(r)), key=repr)
    assert intervals.outside(frames[0], frames[1].limit(0)).count() == len(rows) and intervals.outside(frames[0].limit(0), frames[1]).count() == 0


def test_comments_outside_docstrings(spark):
    """What the parser of Python decides within a file, as a join of rows."""
    text = 'def f():\n    """文 # 一\n    # 二\n    """\n    return 1  # 三\n'
    files = spark.createDataFrame([("a.py", text.encode())], "path string, content binary")
    marks = spark.createDataFrame([("a.py", len(text[: text.index(x)].encode()), len(text[: text.index(x)].encode()) + 5) for x in ("# 一", "# 二", "# 三")], "path string, start_byte long, end_byte long")
    docs = parsers.parse(files).filter("kind = 'docstring'").select("path", "start_byte", "end_byte")
    assert [r.start_byte for r in intervals.outside(marks, docs).collect()] == [len(text[: text.index("# 三")].encode())]


def test_a_plug_in_from_sql(spark):
    def entries(text, suffix):
        """A plug-in: the second column of lines of three."""
        at = 0
        for line in text.split("\n"):
            parts = line.split(";")
            if len(parts) == 3:
                start = at + len(parts[0]) + 1
                yield start, start + len(parts[1]), "string", bool(parts[2]), suffix
            at += len(line) + 1

    rows = [("a.csv", "1;一 é;x\n2;二;\nbad\n".encode()), ("dir.x/.csv", "3;三;z".encode()), ("b.CSV", b"\xff;"), ("c.csv", None)]
    spark.createDataFrame(rows, "path string, content binary").createOrReplaceTempView("plugged_files")
    parsers.register(spark, "entries_of", entries)
    got = spark.sql("SELECT path, s.* FROM plugged_files, LATERAL entries_of(path, content) s ORDER BY path, start_byte").collect()
    assert [tuple(r) for r in got] == [("a.csv", "string", 2, 8, "一 é", True, ".csv"), ("a.csv", "string", 13, 16, "二", False, ".csv"), ("dir.x/.csv", "string", 2, 5, "三", True, "")]
    by_suffix = parsers.parse_all(spark.table("plugged_files").filter("content is not null"), {".csv": entries}).filter("translatable")
    assert [(r.path, r.source_text) for r in by_suffix.collect()] == [("a.csv", "一 é")]
    # the parsers of the library are table functions as well
    parsers.register(spark, "markdown_of", parsers.markdown)
    spark.createDataFrame([("x.md", "# 题\n".encode())], "path string, content binary").createOrReplaceTempView("plugged_files")
    assert [tuple(r)[1:4] for r in spark.sql("SELECT * FROM plugged_files f, LATERAL markdown_of(f.path, f.content) s").select("path", "kind", "start_byte", "source_text").collect()] == [("markdown_heading", 2, "题")]
    assert extract.SPAN
