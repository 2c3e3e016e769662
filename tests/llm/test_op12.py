"""The conversation trie against a plain one of nested dicts, and against SQL on the whole table."""

import hashlib
import random
import zlib

import duckdb
import pytest

from lexloom.llm import op12_conversation_trie as op
from lexloom.llm.queries import op12_conversation_trie_query

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
DDL = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every node by its path, with its members written out."""
    given = {}
    for c, turn, role, text in rows:
        if c is not None:
            given.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in given.items()}
    members = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = turns.get(c - c % 20, [])[:h] + own[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append((c, d == len(path)))
    out = {}
    for node, held in members.items():
        words = len([w for w in node[-1][1].translate({k: " " for k in range(9, 14)}).split(" ") if w]) if node else 0
        out[node] = {
            "conv_id": min(c for c, _ in held), "depth": len(node), "n_convs": len(held), "n_children": 0, "n_leaves": 0, "saved_tokens": 0,
            "own": (len(held) - 1) * words, "ends_sha256": hashlib.sha256(",".join(str(c) for c, end in sorted(held) if end).encode()).hexdigest(),
        }
    for node in out:
        out[node]["parent_conv_id"] = out[node[:-1]]["conv_id"] if node else None
        if node:
            out[node[:-1]]["n_children"] += 1
    for node, r in out.items():
        for d in range(len(node) + 1):
            out[node[:d]]["saved_tokens"] += r["own"]
            out[node[:d]]["n_leaves"] += r["n_children"] == 0
    return sorted((tuple(r[n] for n in NAMES) for r in out.values()), key=repr)


def found(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed):
    """Conversations over few texts, so that many paths are shared; one with a third of all rows, one text in most first turns."""
    r = random.Random(seed)
    rows, ids = [], r.sample(range(0, 130), 60)
    for c in ids:
        for t in range(r.choice([1, 1, 2, 3, 4, 5])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a b", "a  b\tc", None, "", "é  x", "long " * 30])))
            if t == 0 and r.random() < 0.6:
                rows[-1] = (c, None, "user", "hello there")
    rows += [(ids[0], 10 + k, "user", f"turn {k % 7}") for k in range(len(rows) // 2)]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_a_plain_trie(spark, seed):
    rows = made(seed)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that the largest conversation is many parts
    try:
        assert found(op.conversation_trie(spark.createDataFrame(rows, DDL).repartition(5))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_that_end_together(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(20, 420) for t in range(2)]
    old, op.PACK = op.PACK, 7
    try:
        assert found(op.conversation_trie(spark.createDataFrame(rows, DDL))) == brute(rows)
    finally:
        op.PACK = old


def test_cases(spark):
    # turnless ones (all own turns fall before h and there is no base), repeated rows, rows without an id, clashing columns
    rows = [(c, 0, "user", "x y") for c in (21, 22, 23, 24, 25, 26)] + [(3, 1, "user", "r r"), (3, 1, "user", "r r"), (None, 0, "user", "lost"), (40, None, None, None)]
    docs = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], DDL + ", depth int, k int, part string")
    got = found(op.conversation_trie(docs))
    assert got == brute(rows)
    assert [r[3] for r in got if r[1] == 0] == [8]
    assert op.conversation_trie(docs.limit(0)).collect() == []


def test_whole_table_against_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = c.execute(f"SELECT {', '.join(NAMES)} FROM ({op.SQL})").fetchall()
    assert found(op12_conversation_trie_query(spark, sf_dir)) == sorted(want, key=repr)


def test_shuffles_are_few(spark):
    """Each shuffle is a task a partition, which small conversations over many partitions can't pay for again and again."""
    tracker, partitions = spark.sparkContext.statusTracker(), 23
    for key, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", str(partitions))):
        spark.conf.set(key, value)
    spark.sparkContext.setJobGroup("few-shuffles", "op12")
    try:
        rows = made(7)
        assert found(op.conversation_trie(spark.createDataFrame(rows, DDL))) == brute(rows)
        stages = {s for job in tracker.getJobIdsForGroup("few-shuffles") for s in tracker.getJobInfo(job).stageIds}
        done = [info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s))]
        assert 0 < sum(done) <= 16 * partitions, sorted(done)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
