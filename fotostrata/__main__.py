"""Commands: scan, dedupe, inspect, explain, audit-metadata, organize (moves) and import (copies)."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import fields

from pyspark.sql import functions as F

from fotostrata import __version__
from fotostrata.operators import duplicates, review
from fotostrata.plans import execute, inspect, organize, reports
from fotostrata.session import build_session, materialise, purge
from fotostrata.sources.hashing import hash_files
from fotostrata.sources.listing import ignored_count, images, list_files
from fotostrata.sources.manifest import DEFAULTS, HttpGeocoder, ManifestError, Settings, check_settings, load_rules, load_settings, read_journal, settings_from


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fotostrata", description="Plan and carry out the organization of media collections with Spark.")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("--master", help="Spark master, for example local[8]")
    top.add_argument("--log-level", default="WARN", choices=("DEBUG", "INFO", "WARN", "ERROR"))
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("scan", "dedupe", "inspect", "explain", "audit-metadata", "organize", "import"):
        sub = commands.add_parser(name)
        sub.add_argument("source")
        sub.add_argument("--flat", action="store_true", help="do not look into folders")
        sub.add_argument("--report", help=".json for one document, .csv or a folder name for rows")
        if name in ("inspect", "explain", "audit-metadata", "organize", "import"):
            sub.add_argument("--config")
            sub.add_argument("--correction-manifest")
            sub.add_argument("--correction-priority")
            sub.add_argument("--reconciliation-policy")
            sub.add_argument("--clock-offset")
            sub.add_argument("--date-heuristics", action=argparse.BooleanOptionalAction)
        if name in ("organize", "import"):
            sub.add_argument("--review-report")
            sub.add_argument("--quarantine-dir", help="where files that cannot be planned are copied; default .quarantine in the output")
            sub.add_argument("--geocoder-url", help="reverse geocoding service that answers JSON with an address")
            sub.add_argument("--geocoder-timeout", type=float, default=5.0)
            sub.add_argument("--resume", action="store_true", help="leave out what the journal says succeeded")
            sub.add_argument("--by", dest="strategy")
            known = {a.dest for a in sub._actions}
            for f in fields(Settings):
                if f.name in known:
                    continue
                option, kind = "--" + f.name.replace("_", "-"), str(f.type)
                if kind.startswith("bool"):
                    sub.add_argument(option, action=argparse.BooleanOptionalAction)
                elif kind.startswith("tuple"):
                    sub.add_argument(option, action="append")
                else:
                    sub.add_argument(option, type=int if kind.startswith("int") else float if kind.startswith("float") else str)
    return top


def settings_of(args: argparse.Namespace) -> Settings:
    """The command line over the settings file over the command's defaults."""
    names = {f.name for f in fields(Settings)}
    given = settings_from({k: v for k, v in vars(args).items() if k in names and v is not None})
    file = load_settings(args.config) if args.config else Settings()
    command = Settings(mode="copy" if args.command == "import" else "move")
    merged = given.over(file).over(command).over(DEFAULTS)
    if merged.strategy == "event" and not merged.event_window_minutes:
        merged = Settings(event_window_minutes=60).over(merged)
    return check_settings(merged)


def save(summary, rows, path: str | None, name: str) -> None:
    if path:
        reports.write_document(summary, rows, path, name) if path.endswith(".json") else reports.write_rows(rows, path)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        settings = settings_of(args) if hasattr(args, "config") else None
        rules, priority = load_rules(settings.correction_manifest) if settings and settings.correction_manifest else ([], "highest")
    except ManifestError as problem:
        print(problem, file=sys.stderr)
        return 2
    if not os.path.isdir(args.source):
        print(f"no such folder: {args.source}", file=sys.stderr)
        return 2
    spark = build_session(master=args.master, **{"spark.ui.showConsoleProgress": "false"})
    try:
        spark.sparkContext.setLogLevel(args.log_level)
        return run(spark, args, settings, rules, priority)
    finally:
        purge(spark)


def run(spark, args, settings: Settings | None, rules, priority: str) -> int:
    deep = not args.flat
    if args.command == "scan":
        files = list_files(spark, args.source, deep)
        review.histogram(images(files), "ext", "length").orderBy("ext").show(100, False)
        print(f"ignored files: {ignored_count(files).first()[0]}")
        return 0
    if args.command == "dedupe":
        hashed = materialise(hash_files(images(list_files(spark, args.source, deep))), "hashed")
        groups = duplicates.duplicate_groups(hashed, list_up_to=1_000)
        groups.drop("duplicates").show(100, False)
        # a document has the groups, rows have every file with its role
        rows = groups if (args.report or "").endswith(".json") else duplicates.duplicate_members(hashed)
        save(duplicates.duplicate_summary(hashed), rows, args.report, "groups")
        return 0
    if args.command in ("inspect", "explain", "audit-metadata"):
        items = inspect.inspect_files(spark, args.source, settings.reconciliation_policy, settings.date_heuristics, rules, settings.correction_priority or priority, deep)
        inspect.inspect_summary(items).show(truncate=False)
        rows = {"explain": inspect.explain_items, "audit-metadata": inspect.audit_items}.get(args.command, lambda x: x)(items)
        save(inspect.inspect_summary(items), rows, args.report, "files")
        return 0
    client = HttpGeocoder(args.geocoder_url, args.geocoder_timeout) if args.geocoder_url else None
    plan = organize.plan_organization(spark, args.source, settings, rules, priority, client, deep)
    todo, output = plan.operations, settings.output or args.source
    if args.resume and settings.journal:
        todo, skipped = execute.split_resumable(todo, read_journal(spark, settings.journal))
        print(f"already done: {skipped.count()}")
    outcomes = None
    if not settings.plan_only:
        outcomes = execute.apply_plan(todo, output, settings.conflict_policy, settings.dry_run, settings.staging_dir)
        if settings.journal:
            execute.write_journal(outcomes, todo, settings.journal, args.command, staging=settings.staging_dir is not None)
    unplanned = plan.quarantine.count()
    print(f"files that cannot be planned: {unplanned}")
    if unplanned and outcomes is not None and not settings.dry_run:
        held = execute.quarantine_files(plan.quarantine, args.quarantine_dir or os.path.join(output, ".quarantine"))
        held.groupBy("status").count().show(truncate=False)
    rows = reports.execution_rows(todo, outcomes)
    mode = "plan" if settings.plan_only else "dry-run" if settings.dry_run else "staged" if settings.staging_dir else "execute"
    joined = todo if outcomes is None else todo.join(outcomes.select("source", "status"), "source", "left")
    summary = review.run_summary(joined, mode, plan.ignored, None if outcomes is None else "status")
    summary.show(truncate=False)
    reports.folder_tree(todo).show(40, False)
    save(summary, rows, args.report, "operations")
    if args.review_report:
        flagged = rows.withColumn("review_flags", F.split("review_flags", ";"))
        save(review.review_summary(flagged.where("review_required")), reports.review_rows(rows), args.review_report, "items")
    return 0


if __name__ == "__main__":
    sys.exit(main())
