"""The registered queries on the driver's tables, each with DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import fixed_values as V
from lexloom.functions import language, ngrams
from lexloom.functions import text as T
from lexloom.operators import extract, inplace, parsers, scan, splice, translate, verify
from lexloom.sources.files import documents_as_files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(work):
        QUERIES[name] = work
        if sql is not None:
            SQL[name] = sql
        return work

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_files(_table(spark, sf_dir, "documents"))


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).withColumn("content", F.encode("src", "UTF-8"))


def _target(src):
    return F.replace(src, F.lit("这个"), F.lit("[this]"))


_SRC = """src AS (SELECT doc_id, lang, 'docs/' || lang || '/' || doc_id || '.md' AS path,
  replace(replace(text, ' the ', ' 这个 '), ' and ', ' 和 ') AS src FROM documents)"""
_LN = f"""{_SRC}, cut AS (SELECT *, unnest(string_split(src, chr(10))) AS line, generate_subscripts(string_split(src, chr(10)), 1) AS k FROM src),
ln AS (SELECT doc_id, lang, path, src, k, line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY k
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_start FROM cut)"""
_HAN, _BROAD = V.HAN, V.BROAD
_SEG = f"""{_LN}, han AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS body, line_start + strlen(regexp_extract(line, '^(\\s*)', 1)) AS s
  FROM ln WHERE regexp_matches(line, '{_HAN}')),
seg AS (SELECT doc_id, lang, path, src, k, body AS source_text, s::BIGINT AS start_byte, (s + strlen(body))::BIGINT AS end_byte,
  substr(sha256(concat_ws(chr(31), path, s::BIGINT, (s + strlen(body))::BIGINT)), 1, 16) AS id,
  sha256(concat_ws(chr(31), body, 'string')) AS translation_key FROM han)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.build_segments(extract.line_segments(_files(spark, sf_dir)))


@query("q01_segments_regex", f"WITH {_SEG} SELECT id, path, start_byte, end_byte, source_text, translation_key FROM seg")
def q01(spark, sf_dir):
    return _segments(spark, sf_dir).select("id", "path", "start_byte", "end_byte", "source_text", "translation_key")


@query(
    "q02_segment_context",
    f"""WITH {_SEG} SELECT id, sha256(src) AS file_sha256, k::INT AS line, length(regexp_extract(line, '^(\\s*)', 1))::INT AS "column",
  right(left(src, p), 40) AS context_before, left(substr(src, p + length(source_text) + 1), 40) AS context_after
FROM (SELECT seg.*, ln.line, (length(array_to_string(string_split(seg.src, chr(10))[:seg.k - 1], chr(10))) + (seg.k > 1)::INT
  + length(regexp_extract(ln.line, '^(\\s*)', 1)))::BIGINT AS p FROM seg JOIN ln ON seg.path = ln.path AND seg.k = ln.k)""",
)
def q02(spark, sf_dir):
    out = extract.build_segments(extract.line_segments(_files(spark, sf_dir), placed=True))
    return out.select("id", "file_sha256", "line", "column", "context_before", "context_after")


@query("q03_manifest_dedup", f"WITH {_SEG} SELECT translation_key, arg_min(source_text, id) AS source_text, count(*) AS n FROM seg GROUP BY 1")
def q03(spark, sf_dir):
    return translate.distinct_keys(_segments(spark, sf_dir)).select("translation_key", "source_text", "n")


@query(
    "q04_memory_hits",
    f"""WITH {_SEG}, memory AS (SELECT DISTINCT translation_key FROM seg WHERE doc_id % 2 = 0)
SELECT translation_key, count(*) AS hits FROM seg JOIN memory USING (translation_key) GROUP BY 1""",
)
def q04(spark, sf_dir):
    files = _files(spark, sf_dir)
    segments = extract.build_segments(extract.line_segments(files))
    memory = extract.build_segments(extract.line_segments(files.filter("doc_id % 2 = 0"))).select("translation_key").distinct()
    return segments.join(memory, "translation_key", "left_semi").groupBy("translation_key").agg(F.count("*").alias("hits"))


@query(
    "q05_translate_provider",
    f"WITH {_SEG} SELECT DISTINCT translation_key, replace(replace(source_text, '这个', 'the'), '和', 'and') AS target_text FROM seg",
)
def q05(spark, sf_dir):
    keys = translate.distinct_keys(_segments(spark, sf_dir))
    return translate.provide(keys, translate.Dictionary({"这个": "the", "和": "and"}))


def _spliced(spark, sf_dir, fault=None):
    files = _content(spark, sf_dir)
    segments = extract.build_segments(extract.line_segments(files, placed=True)).withColumn("doc_id", F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long"))
    segments = segments.withColumn("target_text", _target(F.col("source_text")))
    return splice.splice(files, fault(segments) if fault else segments)


@query(
    "q06_apply_splice",
    f"WITH {_SEG} SELECT DISTINCT path, 'ok' AS status, sha256(replace(src, '这个', '[this]')) AS new_sha256, count(*) OVER (PARTITION BY path)::INT AS applied FROM seg",
)
def q06(spark, sf_dir):
    return _spliced(spark, sf_dir).select("path", "status", F.sha2("content", 256).alias("new_sha256"), "applied")


_FAULT = f"""WITH {_SEG}, files AS (SELECT path, any_value(src) AS src, any_value(doc_id) AS doc_id, count(*) AS n FROM seg GROUP BY 1)
SELECT path, CASE WHEN doc_id % 7 = 0 THEN '%s' ELSE 'ok' END AS status, (CASE WHEN doc_id %% 7 = 0 THEN 0 ELSE n END)::INT AS applied,
  sha256(CASE WHEN doc_id %% 7 = 0 THEN src ELSE replace(src, '这个', '[this]') END) AS new_sha256 FROM files""".replace("doc_id % 7", "doc_id %% 7")


def _fault_query(name, status, change):
    @query(name, _FAULT % status)
    def work(spark, sf_dir):
        return _spliced(spark, sf_dir, change).select("path", "status", "applied", F.sha2("content", 256).alias("new_sha256"))

    return work


_seventh = "doc_id % 7 = 0"
q07 = _fault_query("q07_hash_guard", "mismatch", lambda s: s.withColumn("file_sha256", F.when(F.expr(_seventh), "other").otherwise(F.col("file_sha256"))))
q08 = _fault_query("q08_drift_guard", "drift", lambda s: s.withColumn("source_text", F.when(F.expr(_seventh), F.concat("source_text", F.lit("!"))).otherwise(F.col("source_text"))))
q09 = _fault_query(
    "q09_overlap_guard", "overlap",
    lambda s: s.unionByName(s.filter(_seventh).withColumn("start_byte", F.col("start_byte") + 1).withColumn("target_text", F.lit(None).cast("string"))),
)


@query(
    "q10_greedy_overlap",
    """WITH RECURSIVE iv AS (SELECT l_orderkey, l_linenumber AS k, (l_partkey % 50)::BIGINT AS s, (l_partkey % 50 + 1 + l_suppkey % 20)::BIGINT AS e FROM lineitem),
o AS (SELECT l_orderkey, s, e, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, e, k) AS r FROM iv),
walk AS (SELECT l_orderkey, r, s, e, e AS upto, true AS ok FROM o WHERE r = 1
  UNION ALL SELECT o.l_orderkey, o.r, o.s, o.e, CASE WHEN o.s >= w.upto THEN o.e ELSE w.upto END, o.s >= w.upto
  FROM walk w JOIN o ON o.l_orderkey = w.l_orderkey AND o.r = w.r + 1)
SELECT l_orderkey::VARCHAR AS path, s AS start_byte, e AS end_byte FROM walk WHERE ok""",
)
def q10(spark, sf_dir):
    spans = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("path"), F.lit("string").alias("kind"), (F.col("l_partkey") % 50).cast("long").alias("start_byte"),
        (F.col("l_partkey") % 50 + 1 + F.col("l_suppkey") % 20).cast("long").alias("end_byte"), F.lit("").alias("source_text"),
    )
    return extract.greedy(spans).select("path", "start_byte", "end_byte")


@query("q11_audit", f"WITH {_LN} SELECT path, k::INT AS line, left(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 200) AS snippet FROM ln WHERE regexp_matches(line, '{_HAN}')")
def q11(spark, sf_dir):
    return verify.audit(_files(spark, sf_dir)).select("path", "line", "snippet")


def _trees(spark, sf_dir):
    files = _content(spark, sf_dir).withColumns({"is_symlink": F.lit(False), "link_target": F.lit(None).cast("string")})
    return files.filter("doc_id % 5 <> 0"), files.filter("doc_id % 7 <> 0")


@query(
    "q12_verify_presence",
    f"""WITH {_SRC} SELECT path AS file, CASE WHEN doc_id % 7 = 0 THEN 'missing_file' ELSE 'extra_file' END AS issue_type,
  CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'warning' END AS severity FROM src WHERE (doc_id % 5 = 0) <> (doc_id % 7 = 0)""",
)
def q12(spark, sf_dir):
    return verify.verify(*_trees(spark, sf_dir), contents=False).select("file", "issue_type", "severity")


def _marked(spark, sf_dir):
    """Two versions of each document with tokens put in front; every k-th one is changed in the target."""
    docs = _files(spark, sf_dir)
    n = F.col("doc_id").cast("string")
    head = F.concat(F.lit("See https://x.org/"), n, F.lit(" and {name} for `code"), n, F.lit("`.\n```py\nx = "), n, F.lit("\n```\n"))
    other = F.concat(
        F.lit("See https://x.org/"), F.when(F.col("doc_id") % 3 == 0, "moved").otherwise(n), F.lit(" and "), F.when(F.col("doc_id") % 4 == 0, "name").otherwise("{name}"),
        F.lit(" for `code"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(n), F.lit("`.\n```py\nx = "), F.when(F.col("doc_id") % 6 == 0, "0.5").otherwise(n), F.lit("\n```\n"),
    )
    return docs.select("doc_id", "path", F.concat(head, "src").alias("a"), F.concat(other, _target(F.col("src"))).alias("b"))


_MARKED = f"""{_SRC}, m AS (SELECT doc_id, path, 'See https://x.org/' || doc_id || ' and {{name}} for `code' || doc_id || '`.' || chr(10) || '```py' || chr(10) || 'x = ' || doc_id || chr(10) || '```' || chr(10) || src AS a,
  'See https://x.org/' || CASE WHEN doc_id % 3 = 0 THEN 'moved' ELSE doc_id::VARCHAR END || ' and ' || CASE WHEN doc_id % 4 = 0 THEN 'name' ELSE '{{name}}' END || ' for `code' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE doc_id::VARCHAR END
  || '`.' || chr(10) || '```py' || chr(10) || 'x = ' || CASE WHEN doc_id % 6 = 0 THEN '0.5' ELSE doc_id::VARCHAR END || chr(10) || '```' || chr(10) || replace(src, '这个', '[this]') AS b FROM src)"""
_DIFFER = f"""{_MARKED}, issues AS (
  SELECT path AS file, 'url_changed' AS issue_type FROM m WHERE list_sort(regexp_extract_all(a, '{V.URL.replace("'", "''")}')) <> list_sort(regexp_extract_all(b, '{V.URL.replace("'", "''")}'))
  UNION ALL SELECT path, 'email_changed' FROM m WHERE list_sort(regexp_extract_all(a, '{V.EMAIL}')) <> list_sort(regexp_extract_all(b, '{V.EMAIL}'))
  UNION ALL SELECT path, 'placeholder_changed' FROM m WHERE list_sort(regexp_extract_all(a, '{V.PLACEHOLDER}')) <> list_sort(regexp_extract_all(b, '{V.PLACEHOLDER}'))
  UNION ALL SELECT path, 'code_block_changed' FROM m WHERE regexp_extract_all(a, '{V.CODE_BLOCK}', 1) <> regexp_extract_all(b, '{V.CODE_BLOCK}', 1)
  UNION ALL SELECT path, 'inline_code_changed' FROM m WHERE list_sort(regexp_extract_all(a, '{V.INLINE_CODE}', 1)) <> list_sort(regexp_extract_all(b, '{V.INLINE_CODE}', 1)))"""


def _issues(spark, sf_dir):
    return verify.token_issues(_marked(spark, sf_dir))


@query("q13_verify_tokens", f"WITH {_DIFFER} SELECT file, issue_type, 'error' AS severity FROM issues")
def q13(spark, sf_dir):
    return _issues(spark, sf_dir).select("file", "issue_type", "severity")


@query("q14_code_blocks", f"WITH {_MARKED} SELECT path, regexp_extract_all(a, '{V.CODE_BLOCK}', 1)[1] AS first_block FROM m")
def q14(spark, sf_dir):
    return _marked(spark, sf_dir).select("path", F.get(T.code_blocks(F.col("a")), F.lit(0)).alias("first_block"))


@query("q15_inline_code", f"WITH {_MARKED} SELECT path, array_to_string(list_sort(regexp_extract_all(a, '{V.INLINE_CODE}', 1)), ',') AS codes FROM m")
def q15(spark, sf_dir):
    return _marked(spark, sf_dir).select("path", F.array_join(T.tokens(F.col("a"), V.INLINE_CODE, 1), ",").alias("codes"))


@query("q16_issue_rollup", f"WITH {_DIFFER} SELECT issue_type, count(*) AS n FROM issues GROUP BY 1")
def q16(spark, sf_dir):
    return verify.by_type(_issues(spark, sf_dir))


@query(
    "q17_worst_severity",
    f"""WITH {_SRC} SELECT CASE WHEN count_if(doc_id % 7 = 0) > 0 THEN 'error' WHEN count(*) > 0 THEN 'warning' ELSE 'none' END AS worst_severity,
  count_if(doc_id % 7 = 0) > 0 AS has_errors FROM src WHERE (doc_id % 5 = 0) <> (doc_id % 7 = 0)""",
)
def q17(spark, sf_dir):
    return verify.worst(verify.verify(*_trees(spark, sf_dir), contents=False))


@query("q18_top3_per_type", f"WITH {_DIFFER} SELECT issue_type, file, row_number() OVER (PARTITION BY issue_type ORDER BY file)::INT AS place FROM issues QUALIFY place <= 3")
def q18(spark, sf_dir):
    return verify.top_per_type(_issues(spark, sf_dir)).select("issue_type", "file", "place")


_REVIEW = f"""{_LN}, r AS (SELECT path AS file, k::INT AS line, 'untranslated' AS issue_type, 'error' AS severity FROM ln WHERE len(regexp_extract_all(line, '{_BROAD}')) > 3)"""


@query("q19_review_untranslated", f"WITH {_REVIEW} SELECT * FROM r")
def q19(spark, sf_dir):
    return verify.review(_files(spark, sf_dir)).select("file", "line", "issue_type", "severity")


@query("q20_review_score", f"WITH {_REVIEW} SELECT greatest(0.0::DOUBLE, (100 - 5.0 * count(*))::DOUBLE) AS score, (5.0 * count(*))::DOUBLE AS penalty, count(*) AS issues FROM r")
def q20(spark, sf_dir):
    return verify.score(verify.review(_files(spark, sf_dir)))


@query(
    "q21_path_filter",
    """WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'src/a' || doc_id || '.py' WHEN 1 THEN 'node_modules/b' || doc_id || '.js' WHEN 2 THEN 'web/c' || doc_id || '.min.js'
  WHEN 3 THEN 'docs/.d' || doc_id || '.md' WHEN 4 THEN 'docs/e/f' || doc_id || '.md' ELSE 'img/g' || doc_id || '.png' END AS path FROM documents)
SELECT path FROM p WHERE doc_id % 6 IN (0, 4) AND NOT regexp_matches(path, '7[.]')""",
)
def q21(spark, sf_dir):
    n, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    forms = [("src/a", ".py"), ("node_modules/b", ".js"), ("web/c", ".min.js"), ("docs/.d", ".md"), ("docs/e/f", ".md"), ("img/g", ".png")]
    path = F.element_at(F.array(*[F.concat(F.lit(a), n, F.lit(b)) for a, b in forms]), (kind + 1).cast("int"))
    paths = _table(spark, sf_dir, "documents").select(path.alias("path"))
    return paths.filter(scan.should_translate(F.col("path"), F.lit(10), include=["src/**", "docs/**", "web/**"], exclude=["**/*7.*"]))


@query(
    "q22_cjk_density",
    f"WITH {_SRC} SELECT lang, count(*) AS files, sum(len(regexp_extract_all(src, '{_BROAD}')))::BIGINT AS chars, max(len(regexp_extract_all(src, '{_BROAD}')) * 10000 // greatest(length(src), 1))::BIGINT AS most FROM src GROUP BY 1",
)
def q22(spark, sf_dir):
    n = T.count_broad(F.col("src"))
    most = F.max(F.floor(n * 10000 / F.greatest(F.length("src"), F.lit(1)))).cast("long")
    return _files(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("files"), F.sum(n).cast("long").alias("chars"), most.alias("most"))


@query("q23_needs_translation", "SELECT conv_id, turn::BIGINT AS turn FROM conversations WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 20")
def q23(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    return turns.filter(scan.needs_translation(F.col("text"), F.lit("en"))).select("conv_id", F.col("turn").cast("long").alias("turn"))


@query("q24_resume_anti", f"WITH {_SRC} SELECT path FROM src WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def q24(spark, sf_dir):
    files = _content(spark, sf_dir).withColumn("file_sha256", F.sha2("content", 256))
    done = files.filter("doc_id % 3 = 0").withColumn("file_sha256", F.when(F.col("doc_id") % 2 == 0, "old").otherwise(F.col("file_sha256")))
    return scan.resume(files, done).select("path")


@query("q25_sample_head", f"WITH {_SRC} SELECT path FROM src ORDER BY path LIMIT 20")
def q25(spark, sf_dir):
    return scan.head_sample(_files(spark, sf_dir).select("path"), 20)


@query("q26_sample_hash", f"WITH {_SRC} SELECT path FROM src ORDER BY sha256('0:' || path) LIMIT (SELECT least(greatest(1, floor(count(*) * 0.15)), 50)::BIGINT FROM src)")
def q26(spark, sf_dir):
    return scan.hash_sample(_files(spark, sf_dir).select("path"), 0.15, 50)


@query(
    "q27_batches",
    f"WITH {_SRC}, o AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS ordinal FROM src) SELECT path, ordinal::INT AS ordinal, (ordinal // 40)::BIGINT AS batch, (ordinal % 2)::INT AS engine FROM o",
)
def q27(spark, sf_dir):
    return translate.batches(_files(spark, sf_dir).select("path"), "path", 40, 2).select("path", "ordinal", "batch", "engine")


@query(
    "q29_chunking",
    """WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, lines, 1 AS k, 1 AS chunk, length(lines[1]) AS now FROM d WHERE length(text) > 500
  UNION ALL SELECT doc_id, lines, k + 1, CASE WHEN now + length(lines[k + 1]) + 2 <= 500 THEN chunk ELSE chunk + 1 END,
    CASE WHEN now + length(lines[k + 1]) + 2 <= 500 THEN now + 1 + length(lines[k + 1]) ELSE length(lines[k + 1]) END FROM w WHERE k < len(lines))
SELECT doc_id, chunk::INT AS chunk, string_agg(lines[k], chr(10) ORDER BY k) AS body FROM w GROUP BY 1, 2 UNION ALL SELECT doc_id, 1, text FROM d WHERE length(text) <= 500""",
)
def q29(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.chunks(F.col("text"), 500)).alias("chunk", "body")).withColumn("chunk", F.col("chunk") + 1)


@query(
    "q30_html_strip",
    """SELECT page_id, array_to_string(list_filter(list_transform(string_split(html, chr(10)),
  lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '<[^>]+>', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS prose FROM pages""",
)
def q30(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", extract.prose(F.col("html"), "markup").alias("prose"))


@query(
    "q31_html_segments",
    r"""WITH c AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<(style|script)\b.*?</(style|script)>', '<>', 'g') AS h FROM pages),
n AS (SELECT page_id, regexp_replace(unnest(string_split_regex(h, '<[^>]*>|&#?[A-Za-z0-9]+;?')), '^\s+|\s+$', '', 'g') AS source_text FROM c)
SELECT 'p/' || page_id || '.html' AS path, 'html_text' AS kind, source_text FROM n WHERE source_text <> '' AND source_text NOT LIKE '#%'""",
)
def q31(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return parsers.parse(pages).select("path", "kind", "source_text")


#: What whole texts are freed from where they stand inside a literal or a line of another format.
_UNSAFE = r"[\x00-\x1f\x22'`\\/<>{}()\[\]|$%#*]"


def _one_line(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), _UNSAFE, " ")


_CLEAN = f"""{_SRC}, clean AS (SELECT doc_id, regexp_replace(coalesce(src, ''), '{_UNSAFE.replace("'", "''")}', ' ', 'g') AS body FROM src)"""


@query(
    "q32_json_values",
    f"""WITH {_CLEAN} SELECT 'docs/' || doc_id || '.json' AS path, 'json_value' AS kind, unnest(['A title ' || doc_id, 'Body ' || body]) AS source_text FROM clean""",
)
def q32(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    content = F.concat(F.lit('{"id": "x-'), n, F.lit('", "A title": {"link": "http://x/y", "t": ["A title '), n, F.lit('", 5, null], "k": "Body '), _one_line(F.col("src")), F.lit('"}}'))
    docs = _files(spark, sf_dir).select(F.concat(F.lit("docs/"), n, F.lit(".json")).alias("path"), F.encode(content, "UTF-8").alias("content"))
    return parsers.parse(docs).select("path", "kind", "source_text")


@query(
    "q33_markdown",
    f"""WITH {_CLEAN}, md AS (SELECT 'docs/' || doc_id || '.md' AS path, doc_id, body FROM clean)
SELECT path, 'markdown_heading' AS kind, 'Title ' || doc_id AS source_text FROM md UNION ALL SELECT path, 'markdown_paragraph', 'item with [label](x.md) text' FROM md
UNION ALL SELECT path, 'markdown_table_cell', 'cell ' || doc_id FROM md UNION ALL SELECT path, 'markdown_table_cell', '右' FROM md UNION ALL SELECT path, 'markdown_link_label', 'only label' FROM md
UNION ALL SELECT path, 'markdown_paragraph', 'Body ' || body FROM md""",
)
def q33(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    head = F.concat(F.lit("# Title "), n, F.lit("\n- [x] item with [label](x.md) text\n```\ncode in fence\n"), F.coalesce("src", F.lit("")))
    src = F.concat(head, F.lit("\n```\n| cell "), n, F.lit(" | 右 |\n|---|---|\n[only label](y.md)\n`code`\nhttps://x.org/a\n> Body "), _one_line(F.col("src")), F.lit("\n"))
    files = _files(spark, sf_dir).select(F.concat(F.lit("docs/"), n, F.lit(".md")).alias("path"), src.alias("src"))
    return extract.markdown_segments(files).select("path", "kind", "source_text")


@query(
    "q34_python_docstrings",
    f"""WITH {_CLEAN} SELECT 'p/' || doc_id || '.py' AS path, unnest(['docstring', 'docstring', 'comment']) AS kind,
  unnest(['Module 文档 ' || doc_id || '.', 'Says 你好 ' || body || chr(10) || '    more', '# 注释 ' || doc_id]) AS source_text FROM clean""",
)
def q34(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    body = _one_line(F.col("src"))
    content = F.concat(F.lit('"""Module 文档 '), n, F.lit('."""\n\n\ndef f():\n    """Says 你好 '), body, F.lit('\n    more"""\n    return "值"  # 注释 '), n, F.lit("\n"))
    files = _files(spark, sf_dir).select(F.concat(F.lit("p/"), n, F.lit(".py")).alias("path"), F.encode(content, "UTF-8").alias("content"))
    return parsers.parse(files).select("path", "kind", "source_text")


@query(
    "q35_code_lexer",
    f"""WITH {_CLEAN} SELECT 'c/' || doc_id || '.tsx' AS path, unnest(['line_comment', 'template_string_fragment', 'template_string_fragment', 'string', 'string', 'jsx_text']) AS kind,
  unnest(['// 注释 ' || body, '你好 ', ' 世界 ' || doc_id, '错误 ' || body, '名字 ' || doc_id, regexp_replace('文本 ' || body, '\\s+$', '')]) AS source_text FROM clean""",
)
def q35(spark, sf_dir):
    n, body = F.col("doc_id").cast("string"), _one_line(F.col("src"))
    content = F.concat(
        F.lit('import a from "模块";\n// 注释 '), body, F.lit("\nconst x = `你好 ${name({a: 1})} 世界 "), n, F.lit('`;\nconsole.log("错误 '), body, F.lit('");\nfetch("/路径");\nreturn <input placeholder="名字 '), n,
        F.lit('" className="类">文本 '), body, F.lit("</input>;\n"),
    )
    files = _files(spark, sf_dir).select(F.concat(F.lit("c/"), n, F.lit(".tsx")).alias("path"), F.encode(content, "UTF-8").alias("content"))
    return parsers.parse(files).select("path", "kind", "source_text")


@query(
    "q36_protected_split",
    f"""WITH {_MARKED} SELECT path, len(regexp_extract_all(a, '{V.PROTECTED.replace("'", "''")}'))::INT AS protected, sha256(a) AS whole_sha256 FROM m""",
)
def q36(spark, sf_dir):
    gaps, found = T.protected_split(F.col("a"))
    return _marked(spark, sf_dir).select("path", F.size(found).alias("protected"), F.sha2(T.weave(gaps, found), 256).alias("whole_sha256"))


@query(
    "q38_token_bag_diff",
    f"WITH {_MARKED} SELECT path, list_sort(regexp_extract_all(a, '{V.PLACEHOLDER}')) = list_sort(regexp_extract_all(b, '{V.PLACEHOLDER}')) AS same FROM m",
)
def q38(spark, sf_dir):
    return _marked(spark, sf_dir).select("path", (T.tokens(F.col("a"), V.PLACEHOLDER) == T.tokens(F.col("b"), V.PLACEHOLDER)).alias("same"))


#: Every fifth document is kept from the profile, so that a share of the answers is on texts it has not seen.
_LEARNED = "doc_id % 5 <> 0"
_SCRIPT_SQL = " ".join(f"WHEN len(regexp_extract_all(prose, '{p}')) * 3 > len(regexp_extract_all(prose, '\\p{{L}}')) THEN '{lang}'" for lang, p in language.SCRIPTS.items())
_GRAMS_SQL = """SELECT {0}, unnest([a, a || b, a || b || c]) AS gram FROM (SELECT {0}, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c
  FROM (SELECT {0}, doc_id AS d, unnest(string_split(s, '')) AS a, generate_subscripts(string_split(s, ''), 1) AS k FROM {1}) WINDOW w AS (PARTITION BY d ORDER BY k))"""
_DETECT = f"""{_SRC}, prose AS (SELECT doc_id, lang, array_to_string(list_filter(list_transform(string_split(src, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS prose FROM src),
spaced AS (SELECT *, ' ' || trim(regexp_replace(lower(prose), '[^\\p{{L}}]+', ' ', 'g')) || ' ' AS s FROM prose),
counts AS (SELECT lang, gram, count(*) AS n FROM ({_GRAMS_SQL.format("lang", f"(SELECT * FROM spaced WHERE {_LEARNED} AND lang IS NOT NULL)")}) WHERE gram <> ' ' GROUP BY 1, 2),
known AS (SELECT DISTINCT gram FROM (SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS place FROM counts) WHERE place <= {ngrams.KEPT}),
cells AS (SELECT lang, gram, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM counts) CROSS JOIN known LEFT JOIN counts USING (lang, gram)),
profile AS (SELECT lang, gram, floor(1000 * ln((n + 0.5) / (sum(n) OVER (PARTITION BY lang) + 0.5 * count(*) OVER (PARTITION BY lang))))::BIGINT AS weight FROM cells),
met AS (SELECT doc_id, gram, count(*) AS n FROM ({_GRAMS_SQL.format("doc_id", "spaced")}) GROUP BY 1, 2),
best AS (SELECT doc_id, arg_max(lang, (score, -ord(lang), lang)) AS best FROM (SELECT doc_id, profile.lang, sum(met.n * weight) AS score FROM met JOIN profile USING (gram) GROUP BY 1, 2) GROUP BY 1),
told AS (SELECT doc_id, lang, CASE WHEN length(prose) < 20 OR prose IS NULL THEN NULL WHEN len(regexp_extract_all(prose, '{_BROAD}')) > 0.1 * length(prose)
  THEN CASE WHEN regexp_matches(prose, '{language.KANA}') THEN 'ja' WHEN regexp_matches(prose, '{language.HANGUL}') THEN 'ko' ELSE 'zh' END {_SCRIPT_SQL} ELSE best END AS detected FROM prose LEFT JOIN best USING (doc_id))"""


def _detected(spark, sf_dir):
    """doc_id, lang and the language detected in the whole prose of each document, by a profile learned from most of them."""
    files = _files(spark, sf_dir)
    prose = files.select("doc_id", "lang", extract.file_prose(F.col("path"), F.col("src")).alias("prose"))
    profile = ngrams.Profile.of(ngrams.train(prose.filter(_LEARNED).select(F.col("prose").alias("text"), "lang")))
    return prose.select("doc_id", "lang", language.detect_prose(F.col("prose"), profile, seen=None).alias("detected"))


@query("q37_detect_language", f"WITH {_DETECT} SELECT doc_id, detected FROM told")
def q37(spark, sf_dir):
    return _detected(spark, sf_dir).select("doc_id", "detected")


@query("q79_detector_accuracy", f"WITH {_DETECT} SELECT {_LEARNED} AS learned, count(*) AS n, count_if(lang = detected) AS agreed FROM told WHERE detected IS NOT NULL AND lang IS NOT NULL GROUP BY 1")
def q79(spark, sf_dir):
    """Answers that agree with the label, for documents that the profile has learned from and for others."""
    told = _detected(spark, sf_dir).filter("detected is not null and lang is not null")
    return told.groupBy(F.expr(_LEARNED).alias("learned")).agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("detected")).alias("agreed"))


_ENGLISH = {"这个": "the", "和": "and"}


@query(
    "q39_inplace_markdown",
    f"""WITH {_LN}, parts AS (SELECT *, regexp_extract(line, '{V.MARKDOWN_PREFIX}', 1) AS prefix FROM ln),
made AS (SELECT path, k, CASE WHEN regexp_matches(line, '{_HAN}') THEN prefix || regexp_replace(replace(replace(substr(line, length(prefix) + 1), '这个', 'the'), '和', 'and'), '^\\s+|\\s+$', '', 'g') ELSE line END AS line FROM parts)
SELECT path, sha256(string_agg(line, chr(10) ORDER BY k)) AS new_sha256 FROM made GROUP BY path""",
)
def q39(spark, sf_dir):
    files = _content(spark, sf_dir).select("path", "content")
    return inplace.rewrite(files, translate.Dictionary(_ENGLISH), translate.staged).select("path", F.sha2("content", 256).alias("new_sha256"))


_QUOTING = {"这个": 'the "one"', "和": "and"}


@query(
    "q40_inplace_source",
    f"""WITH {_CLEAN} SELECT 'src/' || doc_id || '.ts' AS path, 'const a = "x' || doc_id || ' the \\"one\\""; // and "//" ' || doc_id || chr(10) || '  /* the "one" */' || chr(10)
  || 'b = <i title=''plain''>the "one"</i>;' || chr(10) || '// Body ' || replace(replace(body, '这个', 'the "one"'), '和', 'and') || chr(10) AS content FROM clean""",
)
def q40(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    src = F.concat(F.lit('const a = "x'), n, F.lit(' 这个"; // 和 "//" '), n, F.lit("\n  /* 这个 */\nb = <i title='plain'>这个</i>;\n// Body "), _one_line(F.col("src")), F.lit("\n"))
    files = _files(spark, sf_dir).select(F.concat(F.lit("src/"), n, F.lit(".ts")).alias("path"), F.encode(src, "UTF-8").alias("content"))
    out = inplace.rewrite(files, translate.Dictionary(_QUOTING), translate.staged)
    return out.select("path", F.col("content").cast("string").alias("content"))


@query(
    "q41_inplace_json",
    f"""WITH {_CLEAN} SELECT 'd/' || doc_id || '.json' AS path, '{{"这个": ["the ' || doc_id || '", 5, {{"k": "plain", "t": "Body ' || replace(replace(body, '这个', 'the'), '和', 'and') || '"}}]}}' AS content FROM clean""",
)
def q41(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    src = F.concat(F.lit('{"这个": ["这个 '), n, F.lit('", 5, {"k": "plain", "t": "Body '), _one_line(F.col("src")), F.lit('"}]}'))
    files = _files(spark, sf_dir).select(F.concat(F.lit("d/"), n, F.lit(".json")).alias("path"), F.encode(src, "UTF-8").alias("content"))
    out = inplace.rewrite(files, translate.Dictionary(_ENGLISH), translate.staged)
    return out.select("path", F.col("content").cast("string").alias("content"))


@query("q42_language_histogram", f"SELECT detected, count(*) AS n FROM ({SQL['q37_detect_language']}) GROUP BY 1")
def q42(spark, sf_dir):
    return q37(spark, sf_dir).groupBy("detected").agg(F.count("*").alias("n"))
