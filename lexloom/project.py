"""A localisation run over file trees: options once, then each step as a method.  Trees are folders that all executors reach."""

from __future__ import annotations

import logging
import os
import shutil
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import fixed_values as V
from lexloom.functions import language, ngrams
from lexloom.operators import engines, extract, inplace, reports, resume, reviewer, scan, splice, translate, verify
from lexloom.sources import files as S

EAST = ("zh", "ja", "ko")
LOG = logging.getLogger("lexloom")
HEADER = "type string, version int, source_lang string, target_lang string, repo_root string, created_at string"


@dataclass
class Options:
    """What a run is told; engines take comma lists, a reviewer is any object with ``review``."""

    source_lang: str = "zh"
    target_lang: str = "en"
    translator_engine: str = "identity"
    translator_api_key: str = ""
    translator_model: str = ""
    translator_base_url: str = ""
    review_engine: str | None = None
    review_api_key: str = ""
    review_model: str = "gpt-4o-mini"
    review_base_url: str = ""
    review_sample_rate: float = 0.15
    verify: bool = False
    verify_ai: bool = False
    verify_engine: str = "chat"
    verify_api_key: str = ""
    verify_model: str = "gpt-4o-mini"
    verify_base_url: str = ""
    verify_sample_rate: float = 0.15
    verify_max_ai_files: int = 20
    verify_fail_on: str = "error"
    verify_json_output: str | None = None
    include_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    batch_size: int = 40
    max_workers: int = 1  # calls that run at once: the lanes of each engine
    translate_code: bool = False
    code_scope: str = "comments-and-strings"
    dry_run: bool = False
    verbose: bool = False
    export_manifest_path: str | None = None
    apply_manifest_path: str | None = None
    translation_memory_path: str | None = None
    fail_on_source_mismatch: bool = True
    audit_untranslated: bool = False

    def __post_init__(self):
        if self.code_scope not in ("comments", "comments-and-strings"):
            raise ValueError("code_scope is comments or comments-and-strings")
        if self.max_workers < 1:
            raise ValueError("max_workers is 1 or more")
        if not 1 <= self.batch_size <= 100:
            raise ValueError("batch_size is 1 to 100")
        if self.verify_fail_on not in ("never", *V.SEVERITY):
            raise ValueError(f"verify_fail_on is never, {', '.join(V.SEVERITY)}")

    @property
    def config(self) -> dict:
        return {name: getattr(self, name) for name in resume.CONFIG}


def distinct_folders(*folders: str) -> None:
    """Raises where two names stand for one folder."""
    real = [os.path.realpath(f) for f in folders]
    if len(set(real)) < len(real):
        raise ValueError(f"folders must differ: {', '.join(folders)}")


class Localiser:
    def __init__(self, spark: SparkSession, provider: translate.Provider | None = None, reviewer: reviewer.Reviewer | None = None, **options):
        self.spark, self.options = spark, Options(**options)
        o = self.options
        if o.verbose:
            logging.basicConfig(format="%(name)s: %(message)s")
            LOG.setLevel(logging.INFO)
        self.provider = provider or engines.lanes(o.translator_engine, o.source_lang, o.target_lang, o.translator_api_key, o.translator_model, o.translator_base_url, o.max_workers)
        self.reviewer = reviewer or self._reviewer(o.review_engine, o.review_base_url, o.review_api_key, o.review_model)
        self.east = o.source_lang in EAST

    @staticmethod
    def _reviewer(engine, url, key, model):
        return None if engine is None else reviewer.Silent() if engine == "silent" else reviewer.Chat(url, key, model)

    def _tree(self, root: str) -> DataFrame:
        return S.read_tree(self.spark, root, skipped=(V.STATE_FILE,))

    def _chosen(self, files: DataFrame) -> DataFrame:
        return files.filter(self._choice())

    def _choice(self, code: bool | None = None) -> Column:
        o = self.options
        return ~F.col("is_symlink") & scan.should_translate(F.col("path"), F.col("length"), o.include_patterns, o.exclude_patterns, o.translate_code if code is None else code)

    def _chosen_tree(self, root: str, code: bool | None = None) -> DataFrame:
        """The files of a tree that are to be translated; others are neither read nor, in skipped folders, listed."""
        return S.read_tree(self.spark, root, where=self._choice(code), skipped=(V.STATE_FILE, *V.SKIPPED_FOLDERS))

    # manifests

    def extract(self, root: str, manifest: str) -> extract.Extraction:
        """Writes the manifest of a tree; side outputs come back."""
        o = self.options
        made = extract.extract_files(self._chosen_tree(root), o.include_patterns, o.exclude_patterns, o.translate_code, self.east)
        header = self.spark.createDataFrame([("header", 1, o.source_lang, o.target_lang, os.path.abspath(root), datetime.now(UTC).isoformat())], HEADER)
        names = [f.split()[0].strip("`") for f in V.SEGMENT_DDL.split(", ")]
        S.write_manifest(header, made.segments.select(*names), manifest)
        return made

    def translate_manifest(self, manifest: str, out: str) -> dict:
        """Fills a manifest's targets into a new one, and the memory; statistics as a dict."""
        distinct_folders(manifest, out)
        header, segments, faulty = S.read_manifest(self.spark, manifest)
        if first := faulty.orderBy("file", "line").limit(1).collect():
            raise ValueError(f"{first[0].file}, line {first[0].line}: not a segment ({first[0].reason})")
        path = self.options.translation_memory_path
        memory = translate.staged(S.read_memory(self.spark, path))
        made = translate.translate_manifest(translate.staged(segments), memory, self.provider, translate.staged, self.options.batch_size)
        told = header.select(F.from_json("value", HEADER).alias("h")).select("h.*")
        S.write_manifest(told, made.segments.select(*segments.columns), out)
        if path:
            S.write_memory(translate.staged(made.memory), path)
        return made.statistics.first().asDict()

    def apply(self, manifest: str, root: str, out: str) -> dict:
        """Writes a copy of a tree with the manifest's targets in place; statistics as a dict."""
        distinct_folders(root, out)
        if os.path.isdir(out) and os.listdir(out):
            raise splice.ApplyError(f"{out} is not empty")
        files = self._tree(root)
        segments = translate.staged(S.read_manifest(self.spark, manifest)[1])
        spliced = splice.splice(files.filter(~F.col("is_symlink")), segments)
        judged = translate.staged(splice.validated(spliced, files))
        splice.check(judged, segments, not self.options.fail_on_source_mismatch)
        rest = files.join(judged.select("path"), "path", "left_anti").select("path", "content", "link_target")
        S.write_tree(judged.select("path", "content", F.lit(None).cast("string").alias("link_target")).unionByName(rest), out)
        return splice.statistics(judged).first().asDict()

    # whole trees

    def translate(self, root: str, out: str) -> dict:
        """A copy of a tree, translated; files that an earlier run into ``out`` did under the same settings are left as they are.

        A folder that holds no state of an earlier run is replaced.
        """
        distinct_folders(root, out)
        if os.path.isdir(out) and not os.path.exists(os.path.join(out, V.STATE_FILE)) and not self.options.dry_run:
            shutil.rmtree(out)
        return self._translate(root, out)

    def translate_in_place(self, root: str) -> dict:
        return self._translate(root, root)

    def _translate(self, root: str, out: str) -> dict:
        o = self.options
        state = os.path.join(out, V.STATE_FILE)
        files = self._tree(root)
        chosen = self._chosen(files).withColumn("file_sha256", F.sha2("content", 256))
        done = resume.load(self.spark, state, o.config)
        left = translate.staged(scan.resume(chosen, done))
        valid = F.is_valid_utf8(F.col("content").cast("string"))
        texts = left.filter(valid).withColumn("src", F.decode("content", "UTF-8"))
        wanted = scan.needs_translation(F.col("src"), F.lit(o.source_lang)) & scan.enough(extract.file_prose(F.col("path"), F.col("src")))
        work = texts.filter(wanted).select("path", "content")
        memory, remember = self._memory()
        made = translate.staged(inplace.rewrite(work, self.provider, translate.staged, o.code_scope == "comments", self.east, o.batch_size, memory, remember))
        changed = made.filter("status = 'ok'")
        told = left.select("path", "file_sha256", F.length(F.when(valid, F.decode("content", "UTF-8"))).alias("translated_chars"), valid.alias("valid")).join(made.select("path", "status"), "path", "left")
        results = told.select((F.col("valid") & ~F.coalesce(F.col("status"), F.lit("")).isin("invalid", "drift", "overlap", "mismatch")).alias("ok"), F.when(F.col("status") == "ok", "translated").otherwise("skip").alias("action"), "translated_chars", "path", "file_sha256")
        results = translate.staged(results)
        if not o.dry_run:
            if root == out:
                S.write_tree(changed.select("path", "content"), out)
            else:
                # what is done already stays; all else is the changed file or the original
                new = changed.select("path", "content", F.lit(None).cast("string").alias("link_target"))
                rest = files.join(changed.select("path"), "path", "left_anti").join(chosen.select("path", "file_sha256").join(done, ["path", "file_sha256"]).select("path"), "path", "left_anti")
                S.write_tree(new.unionByName(rest.select("path", "content", "link_target")), out)
            kept = results.filter("ok").select("path", "file_sha256")
            if root == out:  # in place, the digest that counts is the new one
                kept = kept.join(changed.select("path", F.sha2("content", 256).alias("new")), "path", "left").select("path", F.coalesce("new", "file_sha256").alias("file_sha256"))
            resume.save(kept, state, o.config)
        return reports.run_statistics(results).first().asDict()

    def _memory(self):
        """The memory of texts that were rewritten in place, and what adds new ones to it; none where no path is given or nothing is to be written."""
        path = self.options.translation_memory_path
        if not path or self.options.dry_run:
            return None, None
        memory = translate.staged(S.read_memory(self.spark, path))

        def remember(fresh: DataFrame) -> None:
            added = fresh.select("translation_key", "source_text", "target_text", F.lit("in place").alias("kind"), F.lit(0).cast("long").alias("hits"))
            S.write_memory(translate.staged(memory.unionByName(added)), path)

        return memory, remember

    # looking at trees

    def audit(self, root: str) -> tuple[DataFrame, DataFrame]:
        """(lines with Han characters, files that can't be read)."""
        files = self._chosen_tree(root, code=True)
        texts = files.filter(F.is_valid_utf8(F.col("content").cast("string"))).withColumn("src", F.decode("content", "UTF-8"))
        return verify.audit(texts), reports.unaudited(files)

    def verify(self, root: str, out: str) -> tuple[DataFrame, DataFrame]:
        """(issues, counters) of two trees; by a model as well, where that is asked for."""
        o = self.options
        source, target = (S.read_tree(self.spark, r, skipped=(V.STATE_FILE, *V.VERIFY_SKIPPED_FOLDERS)) for r in (root, out))
        issues, reviewed = verify.verify(source, target), 0
        if o.verify_ai:
            model = self._reviewer(o.verify_engine, o.verify_base_url, o.verify_api_key, o.verify_model)
            issues = issues.unionByName(reviewer.equivalence(source, target, model, o.verify_sample_rate, o.verify_max_ai_files))
            reviewed = reviewer.sampled(source, target, o.verify_sample_rate, o.verify_max_ai_files)
        issues, counts = translate.staged(issues), reports.counters(source, target, reviewed)
        if o.verify_json_output:
            reports.write_report(reports.report_lines(issues, counts, root, out), o.verify_json_output)
        return issues, counts

    def fails(self, issues: DataFrame) -> bool:
        return verify.should_fail(issues, self.options.verify_fail_on).first().fail

    def review(self, root: str, original: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(issues, score) of a sample of a translated tree."""
        before = S.read_tree(self.spark, original) if original else None
        return reviewer.review(self._chosen_tree(root), before, self.reviewer, self.options.review_sample_rate)

    def detect(self, root: str, sample: int = 20, profile: str | None = None) -> DataFrame:
        """path, language and share of Chinese, Japanese and Korean characters of a random sample of files; with ``profile``
        (a table made by :meth:`learn_languages`) by that.
        """
        files = scan.hash_sample(self._chosen_tree(root), 1.0, sample)
        src = extract.decoded(F.col("content"))
        known = ngrams.Profile.of(self.spark.read.schema(ngrams.PROFILE_DDL).parquet(profile)) if profile else None
        return reports.language_rows(files.withColumn("src", src), language.detect_prose(extract.file_prose(F.col("path"), F.col("src")), known), F.col("src"))

    def learn_languages(self, labelled: str, profile: str) -> int:
        """Writes the profile of a Parquet table of (text, lang); the number of its languages."""
        ngrams.train(self.spark.read.parquet(labelled)).write.mode("overwrite").parquet(profile)
        return self.spark.read.parquet(profile).select("lang").distinct().count()

    def run(self, root: str, out: str) -> dict:
        """The whole run as the options have it: translate or apply, export, review, verify, audit."""
        o = self.options
        told: dict = {"statistics": self.apply(o.apply_manifest_path, root, out) if o.apply_manifest_path else self.translate(root, out)}
        LOG.info("%s: %s", "applied" if o.apply_manifest_path else "translated", told["statistics"])
        if o.export_manifest_path:
            try:
                self.extract(out, o.export_manifest_path)
            except Exception as e:  # an export does not undo a run
                told["export_error"] = str(e)
                LOG.info("manifest not exported: %s", e)
        if self.reviewer is not None and not o.dry_run:
            told["review"] = self.review(out, root)[1].first().asDict()
            LOG.info("review: %s", told["review"])
        if o.verify and not o.dry_run:
            issues, counts = self.verify(root, out)
            told["verification"] = reports.summary(issues, counts)
            told["failed"] = self.fails(issues)
            LOG.info("verification:\n%s", told["verification"])
        if o.audit_untranslated and not o.dry_run:
            told["audit"] = reports.audit_summary(self.audit(out)[0]).first().asDict()
            LOG.info("audit: %s", told["audit"])
        return told
