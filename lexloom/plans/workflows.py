"""Registered queries of whole workflows: extraction with routing, manifests, apply, verification, reports, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexloom import fixed_values as V
from lexloom.functions import text as T
from lexloom.operators import extract, inplace, intervals, parsers, reports, reviewer, scan, splice, translate, verify
from lexloom.plans.catalogue import _BROAD, _DIFFER, _HAN, _LN, _SEG, _SRC, _content, _files, _issues, _segments, _table, _target, query
from lexloom.sources import files

_WORDS = {"这个": "the", "和": "and"}


def _literal(text):
    """A text as the literal of JSON and of C-like code, with its quotes, escapes and line ends."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x09\x0B-\x1F]", " ")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), plain, F.lit('"'))


_BODY = """replace(replace(replace(regexp_replace(coalesce(src, ''), '[\\x00-\\x09\\x0B-\\x1F]', ' ', 'g'), '\\', '\\\\'), '"', '\\"'), chr(10), '\\n')"""
_LITERAL = f"""'"' || {_BODY} || '"'"""
_ENGLISH = "replace(replace(source_text, '这个', 'the'), '和', 'and')"


def _tree(spark, sf_dir):
    """Files of four kinds around the whole text of each document; one in forty is not UTF-8."""
    n, src, kind = F.col("doc_id").cast("string"), F.col("src"), F.col("doc_id") % 4
    code = F.concat(F.lit('const n = "值 '), n, F.lit('";\n/* '), src, F.lit(" */"))
    doc = F.concat(F.lit('"""'), F.regexp_replace(src, r'["\\]', ""), F.lit('"""\nx = 1  # 注 '), n, F.lit("\n"))
    data = F.concat(F.lit('{"k": "值 '), n, F.lit('", "t": ['), F.length(src).cast("string"), F.lit(', "plain words"]}'))
    text = F.when(kind == 0, src).when(kind == 1, code).when(kind == 2, doc).otherwise(data)
    path = F.concat(F.lit("a/"), n, F.element_at(F.array(*map(F.lit, (".txt", ".ts", ".py", ".json"))), (kind + 1).cast("int")))
    content = F.when(F.col("doc_id") % 40 == 0, F.concat(F.encode(text, "UTF-8"), F.lit(b"\xff"))).otherwise(F.encode(text, "UTF-8"))
    return _files(spark, sf_dir).select(path.alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("length"))


_TREE = f"""{_SRC}, t AS (SELECT doc_id, src, regexp_replace(src, '["\\\\]', '', 'g') AS doc FROM src WHERE doc_id % 40 <> 0 AND src IS NOT NULL),
cut AS (SELECT doc_id, unnest(string_split(src, chr(10))) AS line FROM t WHERE doc_id % 4 = 0),
found AS (SELECT 'a/' || doc_id || '.txt' AS path, 'string' AS kind, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS source_text FROM cut WHERE regexp_matches(line, '{_HAN}')
  UNION ALL SELECT 'a/' || doc_id || '.ts', 'string', '值 ' || doc_id FROM t WHERE doc_id % 4 = 1
  UNION ALL SELECT 'a/' || doc_id || '.ts', 'block_comment', '/* ' || src || ' */' FROM t WHERE doc_id % 4 = 1 AND regexp_matches(src, '{_HAN}')
  UNION ALL SELECT 'a/' || doc_id || '.py', 'docstring', doc FROM t WHERE doc_id % 4 = 2 AND regexp_matches(doc, '{_HAN}')
  UNION ALL SELECT 'a/' || doc_id || '.py', 'comment', '# 注 ' || doc_id FROM t WHERE doc_id % 4 = 2
  UNION ALL SELECT 'a/' || doc_id || '.json', 'json_value', '值 ' || doc_id FROM t WHERE doc_id % 4 = 3)"""


@query("q43_extract", f"WITH {_TREE} SELECT path, kind, source_text, sha256(concat_ws(chr(31), source_text, kind)) AS translation_key FROM found")
def q43(spark, sf_dir):
    return extract.extract_files(_tree(spark, sf_dir), translate_code=True).segments.select("path", "kind", "source_text", "translation_key")


@query(
    "q44_extract_side_outputs",
    f"""WITH {_TREE} SELECT 'error' AS output, 'not UTF-8' AS reason, count(*) AS n FROM src WHERE doc_id % 40 = 0
UNION ALL SELECT 'fallback', 'no parser', count(*) FROM t WHERE doc_id % 4 = 0
UNION ALL SELECT 'skipped', 'no Han characters', count_if(doc_id % 4 = 3) + count_if(doc_id % 4 = 2 AND regexp_matches(doc, '\\S') AND NOT regexp_matches(doc, '{_HAN}')) FROM t""",
)
def q44(spark, sf_dir):
    out = extract.extract_files(_tree(spark, sf_dir), translate_code=True)
    parts = (("error", out.errors), ("fallback", out.fallback), ("skipped", out.skipped))
    first, *rest = [df.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(name).alias("output"), "reason", "n") for name, df in parts]
    for df in rest:
        first = first.unionByName(df)
    return first


def _manifest(spark, sf_dir):
    """Segments of which every third document's have a target, and a memory of those of every second one."""
    all_ = _segments(spark, sf_dir).withColumn("doc_id", F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long"))
    segments = all_.withColumn("target_text", F.when(F.col("doc_id") % 3 == 0, F.lit("kept")))
    memory = translate.distinct_keys(all_.filter("doc_id % 2 = 0")).select("translation_key", "source_text", F.concat(F.lit("M "), "source_text").alias("target_text"), "kind", F.lit(7).cast("long").alias("hits"))
    return translate.translate_manifest(segments, translate.staged(memory), translate.Dictionary(_WORDS))


_MANIFEST = f"""{_SEG}, memory AS (SELECT translation_key, arg_min(source_text, id) AS source_text FROM seg WHERE doc_id % 2 = 0 GROUP BY 1),
filled AS (SELECT id, seg.translation_key, CASE WHEN doc_id % 3 = 0 THEN 'target' WHEN memory.translation_key IS NOT NULL THEN 'memory' ELSE 'provider' END AS origin,
  CASE WHEN doc_id % 3 = 0 THEN 'kept' WHEN memory.translation_key IS NOT NULL THEN 'M ' || memory.source_text ELSE replace(replace(seg.source_text, '这个', 'the'), '和', 'and') END AS target_text
  FROM seg LEFT JOIN memory ON seg.translation_key = memory.translation_key)"""


@query("q45_translate_manifest", f"WITH {_MANIFEST} SELECT id, target_text FROM filled")
def q45(spark, sf_dir):
    return _manifest(spark, sf_dir).segments.select("id", "target_text")


@query(
    "q46_manifest_statistics",
    f"""WITH {_MANIFEST} SELECT count(*) AS segments_total, count(target_text) AS segments_translated, count_if(origin = 'memory') AS segments_from_memory,
  count_if(origin = 'provider') AS segments_from_provider, count_if(origin = 'provider') > 0 AS called FROM filled""",
)
def q46(spark, sf_dir):
    made = _manifest(spark, sf_dir).statistics
    return made.select("segments_total", "segments_translated", "segments_from_memory", "segments_from_provider", (F.col("provider_calls") > 0).alias("called"))


@query(
    "q47_memory_after",
    f"""WITH {_MANIFEST} SELECT translation_key, 7 + count_if(origin = 'memory') AS hits FROM memory LEFT JOIN filled USING (translation_key) GROUP BY 1
UNION ALL SELECT translation_key, 0 FROM filled WHERE origin = 'provider' GROUP BY 1""",
)
def q47(spark, sf_dir):
    return _manifest(spark, sf_dir).memory.select("translation_key", "hits")


@query("q48_second_run", f"WITH {_SEG} SELECT count(*) AS segments_total, count(*) AS segments_translated, 0::BIGINT AS segments_from_memory, 0::BIGINT AS segments_from_provider, 0::BIGINT AS provider_calls FROM seg")
def q48(spark, sf_dir):
    first = _manifest(spark, sf_dir)
    return translate.translate_manifest(first.segments, first.memory, translate.Offline(str.upper)).statistics


@query("q49_update_targets", f"WITH {_SEG} SELECT id, CASE WHEN doc_id % 2 = 0 THEN 'new ' || id END AS target_text FROM seg")
def q49(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    changed = segments.filter(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long") % 2 == 0).select("id", F.concat(F.lit("new "), "id").alias("target_text"))
    return translate.update_targets(segments, changed).select("id", "target_text")


_APPLY = f"""{_SRC}, f AS (SELECT doc_id, path, src, len(regexp_extract_all(src, '这个')) > 0 AS has FROM src WHERE src IS NOT NULL AND doc_id % 2 = 0)"""


def _applied(spark, sf_dir):
    """JSON files around whole texts: of some the file changed, of some the target breaks the syntax, of some there is no target."""
    n = F.col("doc_id")
    text = F.concat(F.lit('{"k": "值 '), n.cast("string"), F.lit('", "t": '), _literal(F.col("src")), F.lit("}"))
    files = _files(spark, sf_dir).select("doc_id", F.concat(F.lit("d/"), n.cast("string"), F.lit(".json")).alias("path"), F.encode(text, "UTF-8").alias("content"))
    found = parsers.parse_all(files.select("path", "content")).filter(F.col("source_text").startswith("值 "))
    segments = extract.build_segments(found).join(files.select("path", "doc_id"), "path")
    target = F.when(n % 5 == 0, 'va"lue').when(n % 3 == 0, F.lit(None).cast("string")).otherwise("value")
    segments = segments.withColumn("target_text", target).withColumn("file_sha256", F.when(n % 7 == 0, "other").otherwise(F.col("file_sha256")))
    return splice.validated(splice.splice(files, segments), files)


@query(
    "q50_apply_statistics",
    """SELECT count(*) AS files_processed, count_if(doc_id % 7 <> 0 AND doc_id % 5 <> 0) AS files_spliced, count_if(doc_id % 7 = 0) AS files_skipped_mismatch,
  count_if(doc_id % 7 <> 0 AND doc_id % 5 = 0) AS files_skipped_validation, count_if(doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0) AS segments_applied FROM documents""",
)
def q50(spark, sf_dir):
    return splice.statistics(_applied(spark, sf_dir))


@query(
    "q51_structured_validation",
    f"""WITH {_SRC} SELECT 'd/' || doc_id || '.json' AS path, CASE WHEN doc_id % 7 = 0 THEN 'mismatch' WHEN doc_id % 5 = 0 THEN 'invalid' ELSE 'ok' END AS status,
  '{{"k": "' || CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0 THEN 'value' ELSE '值 ' || doc_id END || '", "t": ' || {_LITERAL} || '}}' AS content FROM src""",
)
def q51(spark, sf_dir):
    return _applied(spark, sf_dir).select("path", "status", F.col("content").cast("string").alias("content"))


@query("q52_overlapping_paths", f"WITH {_SEG} SELECT DISTINCT path FROM seg WHERE doc_id % 5 = 0")
def q52(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    second = segments.filter(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long") % 5 == 0).withColumn("start_byte", F.col("end_byte") - 1).withColumn("end_byte", F.col("end_byte") + 3)
    return splice.overlaps(segments.unionByName(second))


def _pair(spark, sf_dir):
    """Two trees that differ in links, binary files and syntax; contents are whole documents."""
    n, src = F.col("doc_id"), F.coalesce("src", F.lit(""))
    kind = n % 4
    path = F.concat(F.lit("t/"), n.cast("string"), F.element_at(F.array(*map(F.lit, (".txt", ".png", ".json", ".md"))), (kind + 1).cast("int")))
    base = _files(spark, sf_dir).select(n, kind.alias("kind"), path.alias("path"), src.alias("src"))
    data = F.concat(F.lit("["), F.length("src").cast("string"), F.lit("]"))

    def tree(target: bool):
        changed = F.lit(target) & (n % 3 == 0)
        link = F.col("kind") == 0
        content = F.when(F.col("kind") == 1, F.concat(F.lit(b"\x00\x01"), F.encode(F.concat("src", F.when(changed, "x").otherwise("")), "UTF-8"))).when(
            F.col("kind") == 2, F.encode(F.concat(data, F.when(changed, ",").otherwise("")), "UTF-8")
        ).when(F.col("kind") == 3, F.encode(F.concat("src", F.when(changed, "\n```\n").otherwise("")), "UTF-8"))
        return base.select("path", content.alias("content"), link.alias("is_symlink"), F.when(link, F.when(changed, "b").otherwise("a")).alias("link_target"))

    return tree(False), tree(True)


@query(
    "q53_verify_contents",
    """SELECT 't/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.png' ELSE '.json' END AS file,
  CASE doc_id % 4 WHEN 0 THEN 'symlink_changed' WHEN 1 THEN 'binary_changed' ELSE 'syntax_error' END AS issue_type, 'error' AS severity FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 < 3""",
)
def q53(spark, sf_dir):
    return verify.verify(*_pair(spark, sf_dir)).select("file", "issue_type", "severity")


@query(
    "q54_severity_threshold",
    "SELECT a.t AS threshold, a.t <> 'never' AND EXISTS (SELECT 1 FROM documents WHERE doc_id % 3 = 0) AS fail FROM (VALUES ('never'), ('info'), ('warning'), ('error')) a(t)",
)
def q54(spark, sf_dir):
    issues = translate.staged(verify.verify(*_pair(spark, sf_dir)))
    first, *rest = [verify.should_fail(issues, t).select(F.lit(t).alias("threshold"), "fail") for t in ("never", "info", "warning", "error")]
    for df in rest:
        first = first.unionByName(df)
    return first


@query("q55_warnings_below_threshold", "SELECT count(*) = 0 AS fail FROM documents WHERE doc_id % 2 = 1")
def q55(spark, sf_dir):
    source, target = _pair(spark, sf_dir)
    extra = verify.presence(source.filter(F.regexp_extract("path", r"(\d+)", 1).cast("long") % 2 == 0), source)
    return verify.should_fail(extra, "error")


@query("q56_broken_format", f"WITH {_SRC} SELECT 't/' || doc_id || '.md' AS file, 'broken_format' AS issue_type, 'warning' AS severity FROM src WHERE doc_id % 12 = 3 AND len(regexp_extract_all(coalesce(src, ''), '```')) % 2 = 0 OR doc_id % 4 = 3 AND doc_id % 3 <> 0 AND len(regexp_extract_all(src, '```')) % 2 = 1")
def q56(spark, sf_dir):
    files = _pair(spark, sf_dir)[1].filter("content is not null").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("src"))
    return verify.review(files).filter("issue_type = 'broken_format'").select("file", "issue_type", "severity")


@query(
    "q57_verification_counters",
    """SELECT count_if(doc_id % 5 <> 0) AS source_files, count_if(doc_id % 7 <> 0) AS target_files, count_if(doc_id % 5 <> 0 AND doc_id % 7 <> 0) AS common_files,
  count_if(doc_id % 5 <> 0 AND doc_id % 7 <> 0) AS files_checked, 0::BIGINT AS ai_files_reviewed FROM documents""",
)
def q57(spark, sf_dir):
    files = _content(spark, sf_dir)
    return reports.counters(files.filter("doc_id % 5 <> 0"), files.filter("doc_id % 7 <> 0"))


@query(
    "q58_report",
    """SELECT count_if(doc_id % 3 = 0 AND doc_id % 4 < 3) AS issues, count_if(doc_id % 3 = 0 AND doc_id % 4 < 3) > 0 AS has_errors, count(*) AS source_files,
  coalesce(min(CASE WHEN doc_id % 3 = 0 AND doc_id % 4 < 3 THEN 't/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.png' ELSE '.json' END END), '') AS first_file FROM documents""",
)
def q58(spark, sf_dir):
    source, target = _pair(spark, sf_dir)
    lines = reports.report_lines(translate.staged(verify.verify(source, target)), reports.counters(source, target), "a", "b")
    got = lambda path, kind: F.get_json_object("head", path).cast(kind)
    head = lines.filter(F.col("value").startswith("{")).select(F.concat("value", F.lit("]}")).alias("head"))
    first = lines.filter(F.col("value").startswith("    {")).select(F.get_json_object("value", "$.file").alias("first_file"))
    told = head.select(got("$.summary.issues", "long").alias("issues"), got("$.summary.has_errors", "boolean").alias("has_errors"), got("$.files.source", "long").alias("source_files"))
    return told.join(first, how="left").withColumn("first_file", F.coalesce("first_file", F.lit("")))  # one row each


@query(
    "q83_report_lines",
    f"WITH {_DIFFER} SELECT file, issue_type AS type, row_number() OVER (ORDER BY file, issue_type) > 1 AS comma FROM issues",
)
def q83(spark, sf_dir):
    """All issues as lines of one JSON document; all but the first stand behind a comma."""
    issues = translate.staged(_issues(spark, sf_dir))
    files = _content(spark, sf_dir)
    lines = reports.report_lines(issues, reports.counters(files, files), "a", "b").filter(F.col("value").rlike("^   [ ,]\\{"))
    part = lambda name: F.get_json_object(F.substring("value", 5, 1 << 30), f"$.{name}").alias(name)
    return lines.select(part("file"), part("type"), F.col("value").startswith("   ,").alias("comma"))


def _placed_segments(spark, sf_dir):
    made = extract.build_segments(extract.line_segments(_files(spark, sf_dir), placed=True)).withColumn("protected_context", F.lit(None).cast("array<string>"))
    return made.select(*[f.split()[0].strip("`") for f in V.SEGMENT_DDL.split(", ")])


@query("q84_manifest_round_trip", f"WITH {_SEG} SELECT id, path, start_byte, source_text, k::INT AS line, CASE WHEN doc_id % 3 = 0 THEN 'T \"' || id || '\"' END AS target_text FROM seg")
def q84(spark, sf_dir):
    """A manifest of all segments, written, rewritten for every third document, and read in parts."""
    path = f"{translate.shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    header = spark.createDataFrame([("header", 1)], "type string, version int")
    files.write_manifest(header, _placed_segments(spark, sf_dir), path)
    segments = files.read_manifest(spark, path)[1]
    third = segments.filter(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long") % 3 == 0)
    files.rewrite_targets(spark, path, third.select("id", F.concat(F.lit('T "'), "id", F.lit('"')).alias("target_text")))
    return files.read_manifest(spark, path)[1].select("id", "path", "start_byte", "source_text", "line", "target_text")


@query(
    "q85_faulty_lines",
    f"""WITH {_SRC}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS line FROM src)
SELECT doc_id % 16 AS bucket, line, CASE doc_id % 11 WHEN 0 THEN 'fields' WHEN 1 THEN 'fields' WHEN 2 THEN 'range' WHEN 3 THEN 'digest' ELSE 'path' END AS reason FROM n WHERE doc_id % 11 < 5""",
)
def q85(spark, sf_dir):
    """Lines of sixteen files that are no segments, with their numbers; each line holds a whole text."""
    n = F.col("doc_id") % 11
    names = [f.split()[0].strip("`") for f in V.SEGMENT_DDL.split(", ")]
    made = _files(spark, sf_dir).withColumns({
        "id": F.lit("i"), "kind": F.lit("string"), "start_byte": F.lit(0).cast("long"), "end_byte": F.when(n == 2, 0).otherwise(9).cast("long"), "line": F.lit(1), "column": F.lit(0),
        "source_text": F.coalesce("src", F.lit("")), "target_text": F.lit(None).cast("string"), "file_sha256": F.lit("f"), "translation_key": F.lit("k"), "context_before": F.lit(""), "context_after": F.lit(""),
        "path": F.when(n == 4, F.concat(F.lit("/"), "path")).otherwise(F.col("path")), "protected_context": F.lit(None).cast("array<string>"),
    }).withColumn("source_sha256", F.sha2(F.when(n == 3, F.concat("source_text", F.lit("!"))).otherwise(F.col("source_text")), 256))
    whole, more = (F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) for columns in (names, [*names, F.lit(1).alias("more")]))
    value = F.when(n == 0, F.left(whole, F.length(whole) - 1)).when(n == 1, more).otherwise(whole)
    path = f"{translate.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    rows = made.select((F.col("doc_id") % 16).alias("bucket"), "doc_id", value.alias("value"))
    rows.repartition(16, "bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", "value").write.partitionBy("bucket").text(path)
    bad = files.read_manifest(spark, path)[2]
    return bad.select(F.regexp_extract("file", r"bucket=(\d+)", 1).cast("long").alias("bucket"), "line", "reason")


@query("q59_issue_summary", f"WITH {_DIFFER} SELECT issue_type, count(*) AS n, greatest(count(*) - 3, 0) AS more, list_aggregate(list_sort(list(file))[:3], 'string_agg', ',') AS shown FROM issues GROUP BY 1")
def q59(spark, sf_dir):
    told = F.transform("shown", lambda x: F.substring_index(x, ": ", 1))
    return reports.by_type(_issues(spark, sf_dir)).select("issue_type", "n", "more", F.array_join(told, ",").alias("shown"))


@query(
    "q60_audit_summary",
    f"WITH {_LN} SELECT count(*) AS total_findings, count(DISTINCT path) AS files_with_residual FROM ln WHERE regexp_matches(line, '{_HAN}')",
)
def q60(spark, sf_dir):
    return reports.audit_summary(verify.audit(_files(spark, sf_dir)))


@query(
    "q61_first_findings",
    f"WITH {_LN}, f AS (SELECT path, k::INT AS line FROM ln WHERE regexp_matches(line, '{_HAN}')) SELECT path, line, (SELECT greatest(count(*) - 20, 0) FROM f) AS more FROM f ORDER BY path, line LIMIT 20",
)
def q61(spark, sf_dir):
    return reports.first(verify.audit(_files(spark, sf_dir)).select("path", "line"), ["path", "line"])


@query("q62_unaudited", "SELECT 'a/' || doc_id || '.txt' AS path FROM documents WHERE doc_id % 40 = 0")
def q62(spark, sf_dir):
    return reports.unaudited(_tree(spark, sf_dir))


@query(
    "q63_run_statistics",
    f"""WITH {_SRC} SELECT count(*) AS total_files, count_if(doc_id % 6 > 1) AS translated_files, count_if(doc_id % 6 = 1) AS skipped_files, count_if(doc_id % 6 = 0) AS failed_files,
  coalesce(sum(length(src)) FILTER (doc_id % 6 > 1), 0)::BIGINT AS translated_chars FROM src""",
)
def q63(spark, sf_dir):
    kind = F.col("doc_id") % 6
    rows = _files(spark, sf_dir).select((kind != 0).alias("ok"), F.when(kind == 1, "skip").otherwise("translated").alias("action"), F.length("src").alias("translated_chars"))
    return reports.run_statistics(rows)


@query("q64_durations", "SELECT event_id, seconds FROM (SELECT row_number() OVER (ORDER BY doc_id) AS event_id, (doc_id % 1000) / 4.0::DOUBLE AS seconds FROM documents)")
def q64(spark, sf_dir):
    start = F.timestamp_micros(F.col("doc_id") * 1_000_000)
    rows = _table(spark, sf_dir, "documents").select("doc_id", reports.seconds(start, F.timestamp_micros(F.col("doc_id") * 1_000_000 + F.col("doc_id") % 1000 * 250_000)).alias("seconds"))
    return translate.batches(rows, "doc_id", 40, 2).select((F.col("ordinal") + 1).cast("long").alias("event_id"), "seconds")


@query("q65_token_samples", f"WITH {_DIFFER} SELECT path AS file, array_to_string(list_sort(regexp_extract_all(a, '{V.URL.replace(chr(39), chr(39) * 2)}'))[:10], ' ') AS source FROM m WHERE doc_id % 3 = 0")
def q65(spark, sf_dir):
    """The first ten addresses of the source that an issue tells of."""
    told = F.regexp_replace("source", r"^\[|\]$", "")
    return _issues(spark, sf_dir).filter("issue_type = 'url_changed'").select("file", F.replace(told, F.lit(", "), F.lit(" ")).alias("source"))


@query(
    "q66_file_predicates",
    """WITH p AS (SELECT doc_id, length(text) AS n, CASE doc_id % 5 WHEN 0 THEN 'go.sum' WHEN 1 THEN 'a/yarn.lock' WHEN 2 THEN 'b/c' || doc_id || '.md' WHEN 3 THEN 'b/c' || doc_id || '.py' ELSE 'd' || doc_id || '.rst' END AS path FROM documents)
SELECT path, n::BIGINT AS n FROM p WHERE doc_id % 5 IN (2, 4) AND n * 100 <= 500000""",
)
def q66(spark, sf_dir):
    n, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    path = F.when(kind == 0, "go.sum").when(kind == 1, "a/yarn.lock").when(kind == 2, F.concat(F.lit("b/c"), n, F.lit(".md"))).when(kind == 3, F.concat(F.lit("b/c"), n, F.lit(".py"))).otherwise(F.concat(F.lit("d"), n, F.lit(".rst")))
    rows = _table(spark, sf_dir, "documents").select(path.alias("path"), F.length("text").cast("long").alias("n"))
    return rows.filter(scan.should_translate(F.col("path"), F.col("n") * 100, translate_code=False))


@query("q67_binary_probe", "SELECT doc_id, doc_id % 3 < 2 AND (doc_id % 3 = 0 OR length(text) >= 0) AS is_binary FROM documents WHERE text IS NOT NULL")
def q67(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").filter("text is not null")
    raw, kind = F.encode("text", "UTF-8"), F.col("doc_id") % 3
    content = F.when(kind == 0, F.concat(F.lit(b"\x10\x00"), raw)).when(kind == 1, F.concat(raw, F.lit(b"\xe9"))).otherwise(raw)
    return docs.select("doc_id", scan.is_binary(content).alias("is_binary"))


@query(
    "q68_text_predicates",
    f"""WITH {_SRC} SELECT doc_id, regexp_matches(upper(left(src, 12)), '^[\\p{{Lu}}\\p{{Nd}}_]+$') AND NOT regexp_matches(src, '{_HAN}') AS constant,
  len(string_split(b, chr(10))) > 3 AND len(list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '[{{}}]|\\(\\)|=>|;;|import |def |fn |func '))) > len(string_split(b, chr(10))) * 0.7 AS mostly_code,
  translate(src, chr(10) || chr(13), '  ') AS one_line, round(len(regexp_extract_all(src, '{_BROAD}')) * 100.0 / greatest(length(src), 1), 1)::DOUBLE AS percent, length(b) >= 5 AS enough,
  CASE WHEN length(src) > 3000 THEN left(src, 3000) || '...' ELSE src END AS shown
FROM (SELECT *, regexp_replace(src, '^\\s+|\\s+$', '', 'g') AS b FROM src) WHERE src IS NOT NULL""",
)
def q68(spark, sf_dir):
    src = F.col("src")
    return _files(spark, sf_dir).filter("src is not null").select(
        "doc_id", (T.is_machine_constant(F.upper(F.left(src, F.lit(12)))) & ~T.has_han(src)).alias("constant"), T.is_mostly_code(src).alias("mostly_code"),
        T.one_line(src).alias("one_line"), T.broad_percent(src).cast("double").alias("percent"), scan.enough(src).alias("enough"), reviewer.shortened(src).alias("shown"),
    )


@query(
    "q69_row_constraints",
    f"""WITH {_SEG} SELECT id, CASE doc_id % 5 WHEN 0 THEN 'range' WHEN 1 THEN 'path' WHEN 2 THEN 'kind' ELSE 'digest' END AS reason FROM seg WHERE doc_id % 5 < 4""",
)
def q69(spark, sf_dir):
    n = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long") % 5
    rows = _segments(spark, sf_dir).withColumn("n", n)
    faulty = rows.withColumns({
        "end_byte": F.when(F.col("n") == 0, F.col("start_byte")).otherwise(F.col("end_byte")), "path": F.when(F.col("n") == 1, F.concat(F.lit("../"), "path")).otherwise(F.col("path")),
        "kind": F.when(F.col("n") == 2, "verse").otherwise(F.col("kind")), "source_text": F.when(F.col("n") == 3, F.concat("source_text", F.lit("!"))).otherwise(F.col("source_text")),
    })
    return extract.violations(faulty).select("id", "reason")


_ENGLISH_OF = "replace(replace({0}, '这个', 'the'), '和', 'and')"


@query(
    "q70_comments_only",
    f"""WITH {_SRC}, b AS (SELECT doc_id, replace(coalesce(src, ''), '*/', '* /') AS body FROM src) SELECT 'c/' || doc_id || '.ts' AS path,
  'a = "值 ' || doc_id || '"; // the ' || doc_id || chr(10) || '/* first the' || chr(10) || {_ENGLISH_OF.format("body")} || ' */ b = "这个";' || chr(10) AS content FROM b""",
)
def q70(spark, sf_dir):
    """Whole texts as block comments over many lines; strings beside them stay."""
    n = F.col("doc_id").cast("string")
    body = F.replace(F.coalesce("src", F.lit("")), F.lit("*/"), F.lit("* /"))
    src = F.concat(F.lit('a = "值 '), n, F.lit('"; // 这个 '), n, F.lit("\n/* first 这个\n"), body, F.lit(' */ b = "这个";\n'))
    files = _files(spark, sf_dir).select(F.concat(F.lit("c/"), n, F.lit(".ts")).alias("path"), F.encode(src, "UTF-8").alias("content"))
    out = inplace.rewrite(files, translate.Dictionary(_WORDS), translate.staged, comments_only=True)
    return out.select("path", F.col("content").cast("string").alias("content"))


@query(
    "q71_docstring_lines",
    f"""WITH {_SRC}, b AS (SELECT doc_id, regexp_replace(coalesce(src, ''), '["\\\\\\x00-\\x09\\x0B-\\x1F]', ' ', 'g') AS body FROM src) SELECT 'c/' || doc_id || '.py' AS path,
  'def f():' || chr(10) || '    \"\"\"the ' || doc_id || chr(10) || {_ENGLISH_OF.format("body")} || chr(10) || '    \"\"\"' || chr(10) || '    return "这个"' || chr(10) AS content FROM b""",
)
def q71(spark, sf_dir):
    """Whole texts as docstrings; the string that is returned stays."""
    n = F.col("doc_id").cast("string")
    body = F.regexp_replace(F.coalesce("src", F.lit("")), r'["\\\x00-\x09\x0B-\x1F]', " ")
    src = F.concat(F.lit('def f():\n    """这个 '), n, F.lit("\n"), body, F.lit('\n    """\n    return "这个"\n'))
    files = _files(spark, sf_dir).select(F.concat(F.lit("c/"), n, F.lit(".py")).alias("path"), F.encode(src, "UTF-8").alias("content"))
    out = inplace.rewrite(files, translate.Dictionary(_WORDS), translate.staged, comments_only=True)
    return out.select("path", F.col("content").cast("string").alias("content"))


@query(
    "q72_model_review",
    """SELECT 'docs/' || lang || '/' || doc_id || '.md' AS file, 'ai_length' AS issue_type, 'info' AS severity, greatest(0, length(t) - 3000)::VARCHAR AS message FROM
(SELECT doc_id, lang, replace(replace(text, ' the ', ' 这个 '), ' and ', ' 和 ') AS t FROM documents) WHERE length(t) >= 50 AND length(replace(t, '这个', '[this]')) >= 50 AND length(t) > 3000""",
)
def q72(spark, sf_dir):
    class Long:
        """Tells of sources that were shortened; fails on the others, which gives no issue."""

        def review(self, path, source, target):
            assert source.endswith("...") and len(source) == 3003
            return [{"type": "length", "severity": "info", "message": ""}]

    files = _files(spark, sf_dir).filter("src is not null")
    pairs = files.select("path", F.col("src").alias("a"), _target(F.col("src")).alias("b"))
    sizes = files.select(F.col("path").alias("file"), (F.length("src") - 3000).cast("string").alias("message"))
    return reviewer.review_pairs(pairs, Long()).select("file", "issue_type", "severity").join(sizes, "file")


@query(
    "q73_round_robin",
    f"WITH {_SRC} SELECT path, sha256(CASE WHEN (row_number() OVER (ORDER BY path) - 1) % 2 = 0 THEN 'A ' || src ELSE src END) AS text_sha256 FROM src WHERE src IS NOT NULL",
)
def q73(spark, sf_dir):
    """The rule of dealing texts to two engines, on a report's global order."""
    rows = translate.batches(_files(spark, sf_dir).filter("src is not null").select("path", "src"), "path", 40, 2)
    return rows.select("path", F.sha2(F.when(F.col("engine") == 0, F.concat(F.lit("A "), "src")).otherwise(F.col("src")), 256).alias("text_sha256"))


def _escaped_template(text):
    for a, b in (("\\", "\\\\"), ("`", "\\`"), ("$", "\\$")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


@query(
    "q74_template_fragments",
    f"""WITH {_SRC} SELECT doc_id, '值 ' || doc_id || ' ' AS first, ' ' || replace(replace(replace(coalesce(src, ''), '\\', '\\\\'), '`', '\\`'), '$', '\\$') || ' 尾' AS second,
  '${{f({{a: ' || {_LITERAL} || '}})}}' AS kept, '你 ' || doc_id AS shown FROM src""",
)
def q74(spark, sf_dir):
    """Whole texts as a template's fragment, and as a literal inside its expression, which is kept as context."""
    n, src = F.col("doc_id").cast("string"), F.coalesce("src", F.lit(""))
    code = F.concat(F.lit("x = `值 "), n, F.lit(" ${f({a: "), _literal(src), F.lit("})} "), _escaped_template(src), F.lit(' 尾`; if (a > 1 && m("你 '), n, F.lit('") && b < 2) {}\nfetch("/路"); import y from "模";'))
    files = _files(spark, sf_dir).select(F.concat(n, F.lit(".ts")).alias("path"), F.encode(code, "UTF-8").alias("content"))
    # the literal of the expression is a string of its own
    found = parsers.parse_all(files).filter("translatable and (kind <> 'string' or source_text like '你 %')").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_byte", "source_text", "protected_context"))).alias("s"))
    part = lambda k: F.col("s")[k]["source_text"]
    return found.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), part(0).alias("first"), part(1).alias("second"), F.col("s")[0]["protected_context"][0].alias("kept"), part(2).alias("shown"))


_OWN_REASON = f"CASE WHEN regexp_full_match(body, '[\\p{{Lu}}\\p{{Nd}}_]+') THEN 'machine constant' WHEN regexp_matches(body, '{_HAN}') THEN 'text' ELSE 'no Han characters' END"


@query(
    "q75_string_contexts",
    f"""WITH {_SRC}, b AS (SELECT doc_id, {_BODY} AS body FROM src), told AS (
  SELECT doc_id, unnest(['模', '键', 'KEY_ONE', '/路 ' || doc_id, '径 ' || doc_id, '错 ' || doc_id, 'a', '打 ' || doc_id, '类', '测', '名', 'plain ' || doc_id]) AS source_text,
    unnest(['import/module source', 'object key', 'machine constant', 'route/endpoint', 'route/endpoint', 'error message', 'error message', 'console', 'className', 'test selector', 'shown attribute', 'no Han characters']) AS reason FROM b
  UNION ALL SELECT doc_id, body, unnest(['route/endpoint', 'route/endpoint', 'error message', 'console', {_OWN_REASON}, {_OWN_REASON}]) FROM b WHERE regexp_matches(body, '\\S'))
SELECT doc_id, sha256(source_text) AS text_sha256, reason, count(*) AS n FROM told GROUP BY 1, 2, 3""",
)
def q75(spark, sf_dir):
    """Contexts of strings among long and nested arguments: the whole text stands before, beside and within the others."""
    n, text = F.col("doc_id").cast("string"), _literal(F.col("src"))
    lines = [
        'import a from "模"\nx = {"键": 1, k: "KEY_ONE"};\nfetch(', text, ", {h: [f(1), {t: ", text, '}]}, "/路 ', n, '");\nrouter.push(`${g(1)}`, {x: f({y: [2]})}, "径 ', n, '")\n',
        'throw new MyError("a" + fmt(x, ', text, ') + "错 ', n, '");\nconsole.log(', text, ", h(", text, ', [{a: 1}]), "打 ', n, '");\n',
        'y = <b className="类" data-test-id="测" onClick={() => { go(', text, ') }} title="名">文</b>;\nz = "plain ', n, '";\n',
    ]
    code = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    files = _files(spark, sf_dir).select(F.concat(n, F.lit(".tsx")).alias("path"), F.encode(code, "UTF-8").alias("content"))
    doc_id = F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id")
    strings = parsers.parse_all(files).filter("kind = 'string'")
    return strings.groupBy(doc_id, F.sha2("source_text", 256).alias("text_sha256"), "reason").agg(F.count("*").alias("n"))


@query("q76_language_rows", f"WITH {_SRC} SELECT path, coalesce(lang, 'unknown') AS language, coalesce(round(len(regexp_extract_all(src, '{_BROAD}')) * 100.0 / greatest(length(src), 1), 1), 0)::DOUBLE AS cjk_percent FROM src WHERE src IS NOT NULL")
def q76(spark, sf_dir):
    return reports.language_rows(_files(spark, sf_dir).filter("src is not null"), F.col("lang"), F.col("src")).withColumn("cjk_percent", F.col("cjk_percent").cast("double"))


@query(
    "q77_machine_constants",
    """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\\p{L}\\p{Nd}_]+')) AS word FROM documents), u AS (SELECT doc_id, unnest([word, upper(word), upper(word) || '_' || doc_id]) AS word FROM w)
SELECT doc_id, count_if(regexp_full_match(word, '[\\p{Lu}\\p{Nd}_]+')) AS constants, count(*) AS words FROM u GROUP BY 1""",
)
def q77(spark, sf_dir):
    """Words of whole texts, as they are, in capitals, and as names with a number."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[^\p{L}\p{Nd}_]+", -1)).alias("word"))
    words = docs.select("doc_id", F.explode(F.array("word", F.upper("word"), F.concat_ws("_", F.upper("word"), F.col("doc_id").cast("string")))).alias("word"))
    return words.groupBy("doc_id").agg(F.count_if(T.is_machine_constant(F.col("word"))).alias("constants"), F.count("*").alias("words"))


@query(
    "q78_merged_lines",
    f"""WITH {_LN} SELECT path, sha256(CASE WHEN any_value(doc_id) % 3 = 0 THEN string_agg('T ' || line, chr(10) ORDER BY k) || chr(10)
  ELSE string_agg(CASE WHEN regexp_matches(line, '{_BROAD}') THEN 'T ' || line ELSE line END, chr(10) ORDER BY k) END) AS text_sha256 FROM ln GROUP BY path""",
)
def q78(spark, sf_dir):
    told = F.concat(F.lit("T "), F.replace("src", F.lit("\n"), F.lit("\nT ")), F.when(F.col("doc_id") % 3 == 0, "\n").otherwise(""))
    files = _files(spark, sf_dir).filter("src is not null")
    return files.select("path", F.sha2(T.merged_lines(F.col("src"), told, F.lit(".py")), 256).alias("text_sha256"))


_PLAIN = r"[\x00-\x1F\x22'\x23%&*!|>\x5B\x5D`@{}:,?\x5C/-]"


@query(
    "q80_yaml_toml_values",
    f"""WITH {_SRC}, b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(src, ''), '{_PLAIN.replace("'", "''")}', ' ', 'g'), ' +', ' ', 'g')) AS body FROM src)
SELECT 'd/' || doc_id || '.yaml' AS path, 'yaml_value' AS kind, unnest(['标题 ' || doc_id, 'it''s "' || doc_id || '"', 'Body ' || body]) AS source_text FROM b
UNION ALL SELECT 'd/' || doc_id || '.toml', 'toml_value', unnest(['标题 ' || doc_id, 'Body ' || body, 'in "' || doc_id || '" quotes']) FROM b""",
)
def q80(spark, sf_dir):
    """Values of YAML (plain, quoted, in lists, under keys of the same text) and TOML (tables, arrays, literal strings)."""
    n = F.col("doc_id").cast("string")
    body = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("src", F.lit("")), _PLAIN, " "), " +", " "))
    yaml = F.concat(F.lit("标题 "), n, F.lit(": a/b\nlist:\n  - 标题 "), n, F.lit("\n  - 12\n  - it's \""), n, F.lit('"\n  - on\nnested: {other: "Body '), body, F.lit('", name: x-1}\n'))
    toml = F.concat(F.lit('id = "x-'), n, F.lit('"\n[a."标题"]\nt = ["标题 '), n, F.lit('", "b.c"]\nlong = "Body '), body, F.lit("\"\nlit = 'in \""), n, F.lit("\" quotes'\n"))
    files = _files(spark, sf_dir)
    made = [files.select(F.concat(F.lit("d/"), n, F.lit(end)).alias("path"), F.encode(text, "UTF-8").alias("content")) for end, text in ((".yaml", yaml), (".toml", toml))]
    return parsers.parse(made[0].unionByName(made[1])).select("path", "kind", "source_text")


@query(
    "q81_shown_attributes",
    r"""WITH c AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<(style|script)\b.*?</(style|script)>', '<>', 'g') AS h FROM pages),
n AS (SELECT page_id, regexp_replace(unnest(string_split_regex(h, '<[^>]*>|&#?[A-Za-z0-9]+;?')), '^\s+|\s+$', '', 'g') AS source_text FROM c),
a AS (SELECT page_id, unnest(['名 ' || page_id, 'alt of ' || page_id, 'say "' || page_id || '"', 'shown ' || page_id]) AS source_text FROM pages)
SELECT page_id, kind, count(*) AS n, sha256(string_agg(source_text, '|' ORDER BY source_text)) AS texts_sha256 FROM (
  SELECT page_id, 'html_text' AS kind, source_text FROM n WHERE source_text <> '' AND source_text NOT LIKE '#%' UNION ALL SELECT page_id, 'ui_attribute', source_text FROM a) GROUP BY 1, 2""",
)
def q81(spark, sf_dir):
    """Whole pages behind elements with shown attributes, and with others that are not taken."""
    n = F.col("page_id").cast("string")
    head = F.concat(F.lit('<img title="名 '), n, F.lit('" alt=\'alt of '), n, F.lit("' id=\"no "), n, F.lit('"/><input placeholder="#'), n, F.lit('" aria-label=\'say "'), n, F.lit('"\'><a href="x" title=\'shown '), n, F.lit("'></a>"))
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), n, F.lit(".html")).alias("path"), F.encode(F.concat(head, "html"), "UTF-8").alias("content"))
    found = parsers.parse(pages).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("page_id"), "kind", "source_text")
    return found.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("source_text")), "|"), 256).alias("texts_sha256"))


class _Longer:
    """A model that finds translations longer or shorter than their source, and can't read some files."""

    def review(self, path, source, target):
        if path.endswith("7.md"):
            raise ValueError("unreadable")
        return [] if len(source) == len(target) else [{"type": "length", "severity": "info", "message": f"{len(target) - len(source)}"}]


@query(
    "q82_model_equivalence",
    f"""WITH {_SRC}, p AS (SELECT path, src AS a, replace(src, '这个', '[this]') AS b FROM src WHERE src IS NOT NULL AND doc_id % 9 <> 0),
s AS (SELECT * FROM p ORDER BY path LIMIT (SELECT least(greatest(1, floor(count(*) * 0.5)), 200)::BIGINT FROM p)), c AS (SELECT path, CASE WHEN length(a) > 3000 THEN left(a, 3000) || '...' ELSE a END AS a, CASE WHEN length(b) > 3000 THEN left(b, 3000) || '...' ELSE b END AS b, length(a) AS n, length(b) AS m FROM s)
SELECT path AS file, 'ai_length' AS issue_type, 'info' AS severity, (length(b) - length(a))::VARCHAR AS message FROM c WHERE n >= 50 AND m >= 50 AND length(a) <> length(b) AND path NOT LIKE '%7.md'""",
)
def q82(spark, sf_dir):
    """Files of two trees in order of path, as many as the rate asks for, by a model; links, binary and lone files are not asked about."""
    files = _content(spark, sf_dir).filter("src is not null").withColumns({"is_symlink": F.lit(False), "link_target": F.lit(None).cast("string")})
    target = files.withColumn("content", F.encode(_target(F.col("src")), "UTF-8")).filter("doc_id % 9 <> 0")
    return reviewer.equivalence(files, target, _Longer(), 0.5, 200).select("file", "issue_type", "severity", "message")


@query(
    "q86_interval_anti_join",
    """WITH iv AS (SELECT l_returnflag AS path, l_orderkey, l_linenumber, (l_orderkey * 7 + l_linenumber * 3)::BIGINT AS s, (l_orderkey * 7 + l_linenumber * 3 + 1 + l_partkey % 9)::BIGINT AS e, l_suppkey % 4 = 0 AS cover FROM lineitem)
SELECT path, l_orderkey, l_linenumber, s AS start_byte, e AS end_byte FROM iv r WHERE NOT cover AND NOT EXISTS (SELECT 1 FROM iv c WHERE c.cover AND c.path = r.path AND c.s < r.e AND r.s < c.e)""",
)
def q86(spark, sf_dir):
    """Intervals of few large groups that touch none of the covers in their group."""
    place = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3
    spans = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("path"), "l_orderkey", "l_linenumber", place.cast("long").alias("start_byte"), (place + 1 + F.col("l_partkey") % 9).cast("long").alias("end_byte"), (F.col("l_suppkey") % 4 == 0).alias("cover"))
    return intervals.outside(spans.filter("not cover"), spans.filter("cover")).drop("cover")


@query("q87_extractor_from_sql", f"WITH {_TREE} SELECT path, kind, source_text FROM found WHERE kind <> 'string' OR path LIKE '%.ts'")
def q87(spark, sf_dir):
    """The parsers as table functions that SQL calls for each file."""
    view, known = f"files_{uuid.uuid4().hex}", {".ts": parsers.code, ".py": parsers.python, ".json": parsers.structured}
    _tree(spark, sf_dir).createOrReplaceTempView(view)
    calls = []
    for suffix, parser in known.items():
        parsers.register(spark, f"spans_of_{suffix[1:]}", parser)
        calls.append(f"SELECT path, kind, source_text, translatable FROM (SELECT path, content FROM {view} WHERE path LIKE '%{suffix}') f, LATERAL spans_of_{suffix[1:]}(f.path, f.content) s")
    return spark.sql(" UNION ALL ".join(calls)).filter("translatable").filter(T.has_han(F.col("source_text"))).drop("translatable")
