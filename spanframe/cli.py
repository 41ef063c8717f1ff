"""Command line: python -m spanframe.cli generate | audit-sample | audit-check | benchmark | report | token-report | run-report."""

from __future__ import annotations

import argparse
import hashlib
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from spanframe.config import Settings
from spanframe.plans import audit, benchmark, generate, report, token_report
from spanframe.plans.adapters import default_registry, stored_registry
from spanframe.sources.files import blocked_names, gold_rows, timed_runs, token_dump, validated_rows
from spanframe.sources.sinks import write_result, write_text


def session() -> SparkSession:
    return SparkSession.builder.appName("spanframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def tier_spec(text: str) -> dict[str, int]:
    pairs = [x.partition("=") for x in text.split(",")]
    if not all(name and count for name, _, count in pairs):
        raise argparse.ArgumentTypeError(f"not tier=count,...: {text!r}")
    return {name.strip(): int(count) for name, _, count in pairs}


def main(argv: list[str] | None = None) -> int:
    settings = Settings()
    parser = argparse.ArgumentParser(prog="spanframe")
    parser.add_argument("command", choices=("generate", "audit-sample", "audit-check", "benchmark", "report", "token-report", "run-report"))
    parser.add_argument("--seed", type=int, default=settings.seed)
    parser.add_argument("--tier-counts", type=tier_spec)
    parser.add_argument("--testset", type=Path, default=settings.data_dir / "testset" / "test.jsonl")
    parser.add_argument("--audit", type=Path, default=settings.data_dir / "testset" / "AUDIT.md")
    parser.add_argument("--out", type=Path, default=Path("results"))
    parser.add_argument("--systems", nargs="+", default=["all"])
    parser.add_argument("--stored", type=Path, help="a folder of stored predictions and result documents to replay")
    parser.add_argument("--blocklist", type=Path)
    parser.add_argument("--readme", type=Path)
    parser.add_argument("--dumps", type=Path, help="a folder of left_<tokenizer>.json and right_<tokenizer>.json")
    parser.add_argument("--runs", type=Path, nargs="+", help="files of timed runs, later ones appended to the first")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--frozen", action="store_true")
    parser.add_argument("--check", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "generate":
        blocked = blocked_names(session(), str(args.blocklist) if args.blocklist else None)
        write_text(args.testset, generate.to_lines(generate.exact_examples(args.seed, args.tier_counts, blocked)))
        return 0
    if args.command == "report":
        others = sorted(p.stem for p in args.out.glob("*.json") if p.stem not in report.NAMES)
        results, target = report.load_results(args.out, (*report.NAMES, *others)), args.out / "REPORT.md"
        texts = {target: report.benchmark_document(results, report.NAMES)}
        if args.readme:
            texts[args.readme] = report.replace_section(args.readme.read_text(encoding="utf-8"), report.readme_section(results, report.NAMES, str(target)))
        if args.check:
            found = [line for path, text in texts.items() for line in report.drift(path, text)]
            print("\n".join(found), file=sys.stderr)
            return int(bool(found))
        for path, text in texts.items():
            write_text(path, text)
        return 0
    if args.command == "token-report":
        spark, names = session(), sorted(p.stem.removeprefix("left_") for p in args.dumps.glob("left_*.json"))
        pairs = {n: tuple(token_dump(spark, str(args.dumps / f"{side}_{n}.json")) for side in ("left", "right")) for n in names}
        write_result(token_report.token_report(pairs), args.out / "tokens.json")
        return 0
    if args.command == "run-report":
        spark = session()
        write_result({"runs": token_report.run_report([timed_runs(spark, str(p)) for p in args.runs])}, args.out / "runs.json")
        return 0
    sha256 = hashlib.sha256(args.testset.read_bytes()).hexdigest()
    spark, path = session(), str(args.testset)
    if args.command == "benchmark":
        registry = stored_registry(spark, str(args.stored)) if args.stored else default_registry()
        return benchmark.run_all(registry, args.systems, gold_rows(spark, path), args.out, path, sha256, args.limit)
    blank = audit.render_form(validated_rows(spark, path), sha256)
    if args.command == "audit-sample":
        write_text(args.audit, blank, args.force)
        return 0
    text = args.audit.read_text(encoding="utf-8") if args.audit.exists() else None
    check = audit.check_form(spark, text, blank, sha256, args.frozen)
    print(f"{check.state}: {check.total - len(check.incomplete)} of {check.total} questions complete")
    print("\n".join(check.problems), file=sys.stderr)
    return int(not check.ok)


if __name__ == "__main__":
    sys.exit(main())
