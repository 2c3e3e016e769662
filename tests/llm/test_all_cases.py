"""The defined cases of every operator: nulls, empty and repeated rows, clashing columns, empty tables, long texts."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lexloom.llm import op1_token_counts as o1
from lexloom.llm import op2_chat_format as o2
from lexloom.llm import op3_language_id as o3
from lexloom.llm import op4_lm_score as o4
from lexloom.llm import op5_jaccard_join as o5
from lexloom.llm import op6_quality as o6
from lexloom.llm import op7_pii as o7
from lexloom.llm import op8_decontaminate as o8
from lexloom.llm import op9_bpe_codec as o9
from lexloom.llm import op10_telephony as o10

LONG = "the quick brown fox, jumps: over 12 lazy dogs! " * 12_000
ROWS = [(1, None), (2, ""), (3, "same words here again and again"), (3, "same words here again and again"), (4, LONG), (None, "no id at all"), (5, " \n\t")]
CLASHES = "lang source score node sig hub row base near kept held terms term n chunk bucket body media payload feature ids known rest call place".split()


def documents(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    return docs.withColumns({c: F.lit("en" if c == "lang" else "x") for c in CLASHES})


def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 0, 0), (3, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")


RUNS = {
    "op1": lambda s, d: o1.token_counts(d),
    "op3": lambda s, d: o3.identify(d),
    "op4": lambda s, d: o4.score_documents(d),
    "op5": lambda s, d: o5.near_duplicates(d),
    "op6": lambda s, d: o6.score(d, labels(s)),
    "op7": lambda s, d: o7.spans(d),
    "op9": lambda s, d: o9.round_trip(d),
    "op10": lambda s, d: o10.media_digests(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_for_each_document(spark, name):
    docs = documents(spark)
    rows = RUNS[name](spark, docs).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2, 3, 3, 4, 5]
    twice = [tuple(r) for r in rows if r.doc_id == 3]
    assert twice[0] == twice[1]
    empty = {r.doc_id: tuple(r)[2:] for r in rows if r.doc_id in (1, 2)}
    assert name == "op5" or empty[1] == empty[2]  # null counts as empty
    assert RUNS[name](spark, docs.limit(0)).collect() == []
    # the answer does not depend on other columns or partitions
    plain = sorted(map(repr, RUNS[name](spark, docs.select("doc_id", "text", "lang").repartition(3)).collect()))
    assert plain == sorted(map(repr, rows))


def test_chat_cases(spark):
    kind = "conv_id long, turn int, role string, text string, n_turns string, waiting string"
    turns = [(1, 0, "user", None, "x", "y"), (1, 1, None, "a", "x", "y"), (None, 0, "assistant", "b", "x", "y"), (2, 0, "assistant", "c", "x", "y"), (2, 0, "assistant", "c", "x", "y"), (3, 0, "assistant", LONG * 8, "x", "y")]
    docs = spark.createDataFrame(turns, kind)
    got = {r.conv_id: r for r in o2.format_conversations(docs).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, None: 1, 2: 2, 3: 1}
    assert got[2].loss_sha256 == hashlib.sha256(b"cc").hexdigest() and got[2].loss_chars == 2
    assert got[3].loss_chars == len(LONG) * 8 and got[1].loss_chars == 0
    assert o2.format_conversations(docs.limit(0)).collect() == []


def test_leak_cases(spark):
    items = spark.createDataFrame([(1, "same words here again and again"), (2, None), (3, ""), (1, "same words here again and again")], "item_id long, text string")
    docs = documents(spark).withColumns({"item_id": F.lit(9), "distance": F.lit(9)})
    assert sorted((r.doc_id, r.item_id, r.distance) for r in o8.leaks(docs, items).collect()) == [(3, 1, 0)] * 4
    kept = o8.clean(docs, items)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 4, 5]
    assert o8.leaks(docs.limit(0), items).collect() == [] and o8.clean(docs.limit(0), items).collect() == []


def test_codec_stage_and_long_words(spark):
    docs = documents(spark)
    rows = corpus_pipeline.encoding(spark, docs, "").collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2, 3, 3, 4, 5] and all(len(r.ids) == 4 * r.n_tokens for r in rows)
    assert corpus_pipeline.encoding(spark, docs.limit(0), "").collect() == []


def test_equal_ids_keep_one_defined_row(spark):
    rows = [(1, "b text", "k"), (1, "a text", "k"), (1, "a text", "j"), (2, "other words", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    assert sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect())) == [(1, "a text", "j"), (2, "other words", "k")]
