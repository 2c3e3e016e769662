import corpus_pipeline
import numpy as np
import public_tokenizers
from test_op5 import brute as brute_groups
from test_op7 import brute as brute_spans
from tokenizers import Tokenizer

from lexloom.llm import op6_quality, op7_pii, op8_decontaminate
from lexloom.llm.common import table


def test_run_equals_brute_force_stage_by_stage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in op6_quality.score(docs, table(spark, sf_dir, "labels")).filter("keep").collect()}
    rows = {i: t for i, t in rows.items() if i in good}
    first = {i for i, _, c in brute_groups(list(rows.items())) if i == c}
    items = [op8_decontaminate.normal(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    kept = {i: rows[i] for i in first if not any(x in op8_decontaminate.normal(rows[i]) for x in items)}
    number = {k: n for n, k in enumerate(op7_pii.KINDS)}
    clean = {}
    for i, (_, told, *_) in brute_spans(list(kept.items())).items():
        spans = [(int(a), number[k], int(b)) for k, a, b in (s.split(":") for s in told.split(",") if s)]
        clean[i] = op7_pii.rewrite(kept[i], spans)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in clean.items()}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_odd_rows_and_columns(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, row string, grade int"
    rows = [(1, None, "en", "s", 0, 1, "r", 2), (1, None, "en", "s", 0, 1, "r", 2), (2, "", None, None, None, None, None, None), (None, "a b", "en", "s", 3, 1, "r", 2), (5, "same text here", "en", "s", 1, 1, "r", 2), (6, "Same text  here", "en", "s", 1, 1, "r", 2)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    left = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 1, 2, 5]
