"""Command line: ``python -m lexloom.cli COMMAND --help``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from lexloom.operators import engines, reports, verify
from lexloom.project import Localiser


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexloom")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *roots: str):
        made = commands.add_parser(name, help=help_)
        for root in roots:
            made.add_argument(root)
        return made

    def languages(p):
        p.add_argument("--source-lang", default="zh")
        p.add_argument("--target-lang", default="en")

    def choice(p, code: bool = True):
        p.add_argument("--include", dest="include_patterns", action="append", default=[])
        p.add_argument("--exclude", dest="exclude_patterns", action="append", default=[])
        if code:
            p.add_argument("--translate-code", action="store_true")

    def engine(p):
        p.add_argument("--translator", dest="translator_engine", default="identity", help="one engine or a comma list")
        p.add_argument("--api-key", dest="translator_api_key", default=os.environ.get("TRANSLATOR_API_KEY", ""))
        p.add_argument("--model", dest="translator_model", default="")
        p.add_argument("--base-url", dest="translator_base_url", default="")
        p.add_argument("--batch-size", type=int, default=40)
        p.add_argument("--max-workers", type=int, default=1, help="requests of each engine at once, over the whole cluster")
        p.add_argument("--translation-memory", dest="translation_memory_path")

    def reviewing(p, prefix: str = "review-", engine_name: str = "--review-with", engine_default: str | None = None):
        p.add_argument(engine_name, dest="review_engine", default=engine_default, help="chat or silent")
        p.add_argument(f"--{prefix}api-key", dest="review_api_key", default=os.environ.get("REVIEW_API_KEY", ""))
        p.add_argument(f"--{prefix}model", dest="review_model", default="gpt-4o-mini")
        p.add_argument(f"--{prefix}base-url", dest="review_base_url", default="")

    def verifying(p, prefix: str = "verify-", ask: str = "--verify-ai"):
        p.add_argument(ask, dest="verify_ai", action="store_true", help="have a model compare a sample")
        p.add_argument(f"--{prefix}provider", dest="verify_engine", default="chat", help="chat or silent")
        p.add_argument(f"--{prefix}api-key", dest="verify_api_key", default=os.environ.get("REVIEW_API_KEY", ""))
        p.add_argument(f"--{prefix}model", dest="verify_model", default="gpt-4o-mini")
        p.add_argument(f"--{prefix}base-url", dest="verify_base_url", default="")
        p.add_argument(f"--{prefix}sample", dest="verify_sample_rate", type=float, default=0.15)
        p.add_argument(f"--{prefix}max-files", dest="verify_max_ai_files", type=int, default=20)
        p.add_argument("--fail-on" if ask != "--verify-ai" else "--verify-fail-on", dest="verify_fail_on", default="error", choices=["never", "info", "warning", "error"])
        p.add_argument("--json-output" if ask != "--verify-ai" else "--verify-json-output", dest="verify_json_output")

    p = command("translate", "a translated copy of a tree", "root", "out")
    languages(p), choice(p), engine(p), reviewing(p), verifying(p)
    p.add_argument("--review-sample", dest="review_sample_rate", type=float, default=0.15)
    p.add_argument("--code-scope", default="comments-and-strings", choices=["comments", "comments-and-strings"])
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--verify", action="store_true")
    p.add_argument("--export-manifest", dest="export_manifest_path")
    p.add_argument("--apply-manifest", dest="apply_manifest_path", help="put in this manifest's targets instead of translating")
    p.add_argument("--skip-on-source-mismatch", dest="fail_on_source_mismatch", action="store_false")
    p.add_argument("--audit", dest="audit_untranslated", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p = command("extract", "the manifest of a tree", "root", "manifest")
    languages(p), choice(p)
    p = command("translate-manifest", "fill a manifest's targets into a new one", "manifest", "out")
    languages(p), engine(p)
    p = command("apply", "a copy of a tree with a manifest's targets", "manifest", "root", "out")
    p.add_argument("--skip-on-source-mismatch", dest="fail_on_source_mismatch", action="store_false")
    p = command("audit", "lines that still hold Han characters", "root")
    choice(p, code=False)
    p = command("verify", "compare a tree with its translation; exit code 1 beyond the threshold", "root", "out")
    languages(p), verifying(p, "ai-", "--ai-check")
    p = command("review", "check a sample of a translated tree", "root")
    languages(p), reviewing(p, "", "--engine", "silent")
    p.add_argument("--original")
    p.add_argument("--sample-rate", dest="review_sample_rate", type=float, default=0.15)
    p = command("detect", "languages of a sample of a tree", "root")
    p.add_argument("--sample", type=int, default=20)
    p.add_argument("--profile", help="a table that learn-languages has written")
    choice(p)
    command("learn-languages", "the language profile of a Parquet table of text and lang", "labelled", "profile")
    command("engines", "names of all engines")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = vars(parser().parse_args(argv))
    command, roots = given.pop("command"), {k: given.pop(k) for k in ("root", "out", "manifest", "original", "sample", "profile", "labelled") if k in given}
    if command == "engines":
        print("\n".join(sorted(engines.ENGINES)))
        return 0
    made = Localiser(spark or SparkSession.builder.getOrCreate(), **given)
    if command == "translate":
        told = made.run(roots["root"], roots["out"])
        for name, value in told.items():
            print(f"{name}: {value}")
        return int(told.get("failed", False))
    if command == "extract":
        out = made.extract(roots["root"], roots["manifest"])
        print(f"{out.segments.count()} segments, {out.fallback.count()} files read line by line, {out.errors.count()} files not read")
    elif command == "translate-manifest":
        told = made.translate_manifest(roots["manifest"], roots["out"])
        print(f"{told['segments_translated']} of {told['segments_total']} segments ({told['segments_from_memory']} from memory, {told['segments_from_provider']} from the provider)")
    elif command == "apply":
        told = made.apply(roots["manifest"], roots["root"], roots["out"])
        print(f"{told['segments_applied']} segments in {told['files_spliced']} files, {told['files_skipped_mismatch']} files skipped")
    elif command == "audit":
        found, unread = made.audit(roots["root"])
        total = reports.audit_summary(found).first()
        print(f"{total.total_findings} findings in {total.files_with_residual} files, {unread.count()} files not read")
        rows = reports.first(found, ["path", "line"]).collect()
        print("\n".join(f"{r.path}:{r.line} {r.snippet[:80]}" for r in rows))
        if rows and rows[0].more:
            print(f"and {rows[0].more} more")
    elif command == "verify":
        issues, counts = made.verify(roots["root"], roots["out"])
        print(reports.summary(issues, counts))
        return int(made.fails(issues))
    elif command == "review":
        issues, score = made.review(roots["root"], roots["original"])
        print(f"score {score.first().score}")
        print("\n".join(f"{r.issue_type}: {r.n}" for r in verify.by_type(issues).orderBy("issue_type").collect()))
    elif command == "learn-languages":
        print(f"{made.learn_languages(roots['labelled'], roots['profile'])} languages")
    elif command == "detect":
        rows = made.detect(roots["root"], roots["sample"], roots["profile"]).orderBy("path").collect()
        print("\n".join(f"{r.path} {r.language} {r.cjk_percent}%" for r in rows))
    return 0


if __name__ == "__main__":
    sys.exit(main())
