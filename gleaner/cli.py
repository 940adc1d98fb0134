"""Command line: scan paths, list and check rules.

    python -m gleaner.cli scan PATH.. [--no-validate] [--format json|jsonl|bson|sarif|pretty] [--output FILE]
    python -m gleaner.cli rules list|check
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import secrets
import sys
import threading
from collections.abc import Sequence
from contextlib import contextmanager
from functools import reduce

from gleaner.sources.rules import CONFIDENCES, Rule, at_least, check_rules, load_rules, select_rules, with_min_entropy


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gleaner", description="Find leaked credentials.")
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="scan files, folders or Git repositories")
    scan.add_argument("paths", nargs="*", help="files and folders; - (or none, with piped input) is standard input")
    scan.add_argument("--git-history", action="store_true", help="the paths are repositories; scan only their history")
    scan.add_argument("--no-git", action="store_true", help="do not scan the history of repositories below the paths")
    scan.add_argument("--git-repo-timeout", type=float, default=1800.0, metavar="SECONDS", help="what reading the history of a repository may take")
    scan.add_argument("--no-validate", action="store_true", help="do not ask services whether secrets are valid")
    scan.add_argument("--transport", metavar="MODULE:FUNCTION", help="what sends validation requests; HTTP without it")
    scan.add_argument("--redact", action="store_true", help="show salted hashes instead of secrets")
    scan.add_argument("--rule-timeout", type=float, default=60.0, metavar="SECONDS", help="what a rule may take on one content")
    scan.add_argument("--rule-stats", action="store_true", help="tell on standard error how long each rule took")
    scan.add_argument("--snippet-length", type=int, metavar="BYTES", help="show so many bytes around each match (JSON formats)")
    scan.add_argument("--jobs", type=int, help="threads, where Spark runs on this machine")
    scan.add_argument("--format", choices=("pretty", "json", "jsonl", "bson", "sarif"), default="pretty")
    scan.add_argument("--output", help="a file; standard output without it")
    scan.add_argument("--only-valid", action="store_true")
    scan.add_argument("--no-dedup", action="store_true", help="tell a secret at every place")
    scan.add_argument("--min-entropy", type=float)
    scan.add_argument("--max-file-size", type=float, default=25.0, metavar="MB")
    scan.add_argument("--ignore", action="append", default=[], metavar="FILE", help="ignore lists")
    scan.add_argument("--no-binary", action="store_true")
    scan.add_argument("--no-extract-archives", action="store_true")
    scan.add_argument("--extraction-depth", type=int, default=2, choices=range(1, 26), metavar="1-25")
    rules = commands.add_parser("rules", help="list or check rules")
    rules.add_argument("action", choices=("list", "check"))
    rules.add_argument("--format", choices=("pretty", "json"), default="pretty")
    for part in (scan, rules):
        part.add_argument("--rules-path", action="append", default=[])
        part.add_argument("--rule", action="append", default=[], help="id, dotted prefix of ids, or all")
        part.add_argument("--load-builtins", choices=("true", "false"), default="true")
        part.add_argument("--confidence", choices=CONFIDENCES, default="medium")
    return parser


def _rules(args: argparse.Namespace) -> list[Rule]:
    loaded = load_rules(args.rules_path, builtins=args.load_builtins == "true")
    chosen = select_rules(at_least(loaded, args.confidence), args.rule or ["all"])
    if not chosen:
        raise ValueError("No rules to use")
    return chosen


def _list(rules: Sequence[Rule], form: str) -> str:
    if form == "json":
        keys = ("name", "id", "pattern", "confidence", "examples", "visible")
        return json.dumps([{k: getattr(r, k) for k in keys} for r in rules], indent=2)
    width = max(len(r.id) for r in rules)
    return "\n".join(f"{r.id:{width}}  {r.confidence:6}  {r.name}  {' '.join(r.pattern.split())[:80]}" for r in rules)


#: What a prevalidated rule's findings say.
PREVALIDATED = {"validation_success": True, "validation_status": 200, "validation_body": "Prevalidated"}


def _transport(name: str | None):
    from gleaner.operators import validate

    if name is None:
        return validate.http_transport
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError) as error:
        raise ValueError(f"No transport {name!r}: {error}") from error


@contextmanager
def _time_limit(spark, seconds: float):
    """Cancels the Spark jobs of the block once it has run for so long; gives an event that is set then."""
    late, group, context = threading.Event(), f"limited-{secrets.token_hex(8)}", spark.sparkContext

    def stop() -> None:
        late.set()
        # again and again: a job may be between two
        while not done.wait(0.2):
            context.cancelJobGroup(group)

    done, timer = threading.Event(), threading.Timer(seconds, stop)
    timer.daemon = True
    context.setJobGroup(group, "reading a history", interruptOnCancel=True)
    timer.start()
    try:
        yield late
    finally:
        done.set()
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def _scan(args: argparse.Namespace) -> int:
    from pyspark.sql import DataFrame, SparkSession
    from pyspark.sql import functions as F

    from gleaner.operators import dedup, documents, matcher, report, validate
    from gleaner.session import checkpoint, shared_folder
    from gleaner.sources import archives, blobs, git

    rules = with_min_entropy(_rules(args), args.min_entropy)
    piped = "-" in args.paths or (not args.paths and not sys.stdin.isatty())
    paths = [p for p in args.paths if p != "-"]
    if not paths and not piped:
        raise ValueError("Invalid input: no path given")
    for path in paths:
        if "://" not in path and not os.path.exists(path):
            raise FileNotFoundError(f"Invalid input: {path}")
    builder = SparkSession.builder.appName("gleaner")
    spark = (builder.master(f"local[{args.jobs}]") if args.jobs else builder).getOrCreate()
    transport = _transport(args.transport)
    parts = []
    if piped:
        parts.append(blobs.from_bytes(spark, [("stdin_input", sys.stdin.buffer.read())]))
    if paths and not args.git_history:
        parts.append(blobs.from_files(spark, paths, args.max_file_size))
    local = [p for p in paths if "://" not in p and os.path.isdir(p)]
    repos = paths if args.git_history else [] if args.no_git else [r for p in local for r in git.repositories(p)]
    for repo in repos:
        with _time_limit(spark, args.git_repo_timeout) as late:
            try:
                commits, changes = git.read_history(spark, repo)
                introduced = git.first_seen(commits, changes)
            except Exception:
                if not late.is_set():
                    raise
                print(f"{repo}: history not read within {args.git_repo_timeout:g} seconds, left out", file=sys.stderr)
                continue
        parts.append(git.from_history(git.read_objects(spark, repo), commits, introduced, repo))
    if not parts:
        parts.append(blobs.from_bytes(spark, []))
    found = reduce(DataFrame.unionByName, parts)
    ignore = [line for name in args.ignore for line in open(name, encoding="utf-8").read().splitlines()]
    roots = [os.path.abspath(p) for p in local]
    found = blobs.keep(found, args.max_file_size, ignore, args.no_binary, not args.no_extract_archives, roots)
    if not args.no_extract_archives:
        found = archives.expand(found, args.extraction_depth)
    # once: everything below uses the matches, not the contents
    matches = checkpoint(matcher.scan(blobs.described(found), rules, context=args.snippet_length, limit=args.rule_timeout, problems=True))
    for r in matches.where("problem is not null").groupBy("rule_id", "problem").count().collect():
        print(f"{r['rule_id']}: {r['problem']} in {r['count']} contents", file=sys.stderr)
    matches = matches.where("problem is null").drop("problem")
    if not args.no_extract_archives:
        matches = archives.joined(matches)
    if args.rule_stats:
        for r in report.rule_statistics(matcher.timings(found, rules)).collect():
            print(f"{r['rule_id']}: {r['calls']} contents, {r['total']:.3f} s, mean {r['mean']:.6f}, slowest {r['slowest']:.6f} ({r['slowest_blob']})", file=sys.stderr)
    # identical contents are one blob, with the origins of all
    matches = dedup.merge_origins(matches, ["blob_id", "rule_id", "start", "end"], ["fingerprint"])
    if args.no_dedup:
        matches = dedup.one_row_per_origin(matches)
    else:
        first = F.get("origins", F.lit(0))["kind"]
        matches = dedup.first_per_secret(matches.withColumn("kind", first), [blobs.path_of(), F.col("start"), F.col("blob_id")]).drop("kind")
    if args.no_validate:
        matches = matches.withColumns({k: F.when(F.col("prevalidated"), v).otherwise(F.col(k)) for k, v in PREVALIDATED.items()})
    else:
        matches = validate.validated(checkpoint(matches), rules, transport)
    if args.redact:
        matches = report.redact(matches, secrets.token_hex(16))
    matches = checkpoint(matches)
    shown = report.shown(matches, args.only_valid)
    if args.output and args.format in ("json", "sarif"):
        # as many tasks as there are findings for write one document
        folder = f"{shared_folder(spark)}/report-{secrets.token_hex(8)}"
        (report.write_json if args.format == "json" else report.write_sarif)(shown, folder)
        documents.join_files(spark, folder, os.path.abspath(args.output) if "://" not in args.output else args.output)
        return report.exit_code(matches).first()["exit_code"]
    if args.format == "bson":
        data = b"".join(bytes(r["value"]) for r in report.bson(shown).toLocalIterator())
    elif args.format in ("jsonl", "pretty"):
        lines = report.json_lines(shown) if args.format == "jsonl" else report.pretty(shown)
        between = "\n" if args.format == "jsonl" else "\n\n"
        data = between.join(r["value"] for r in lines.toLocalIterator()).encode()
    else:
        data = (report.json_text if args.format == "json" else report.sarif_text)(shown).encode()
    if args.output:
        with open(args.output, "wb") as file:
            file.write(data)
    elif data:
        sys.stdout.buffer.write(data + b"\n")
    if args.format == "pretty":
        counts = report.count_by_rule(shown).collect()
        print(f"{sum(r['findings'] for r in counts)} findings", *(f"  {r['rule_name']}: {r['findings']}" for r in counts), sep="\n", file=sys.stderr)
    return report.exit_code(matches).first()["exit_code"]


def main(argv: Sequence[str] | None = None) -> int:
    """0: nothing found; 200: findings; 205: a validated one; 1: an error."""
    args = _parser().parse_args(argv)
    try:
        if args.command == "scan":
            return _scan(args)
        if args.action == "list":
            print(_list(_rules(args), args.format))
            return 0
        found = check_rules(_rules(args))
        for rule_id, level, message in found:
            print(f"{level}: {rule_id}: {message}")
        return int(any(level == "error" for _, level, _ in found))
    except (OSError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
