"""Commands: scan, file, baseline, check, hotspots, explain.

Exit codes: 0 all right; 1 the ratchet fails, or explain has findings; 2 file has findings; 3 the call is wrong.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import config
from codestrata.operators import churn, findings, ratchet
from codestrata.plans.scan import Report, scan, scan_file
from codestrata.sources import baselines

BASELINE = "codestrata-baseline"


def render_finding(row) -> str:
    place = row.file if row.line is None else f"{row.file}:{row.line}"
    return f"{row.severity.upper():8} {place}  [{row.rule}] {row.message}"


def render_findings(found: DataFrame, limit: int | None = None) -> list[str]:
    total = found.count()
    shown = found.orderBy(*findings.ordering())
    lines = [render_finding(r) for r in (shown if limit is None else shown.limit(limit)).collect()]
    return lines + ([f"... and {total - limit} more"] if limit is not None and total > limit else [])


def _value(value: float | None) -> str:
    """What wasn't measured is said, not shown as 0."""
    return "not measured" if value is None else f"{value:g}" if value == int(value) else f"{value:.4f}"


def render_summary(report: Report) -> list[str]:
    s = report.summary.first()
    values = {r.key: r.value for r in report.aggregates.collect()}
    lines = [f"{s.file_count} files, {s.total_sloc} lines, {s.function_count} functions", f"complexity: cyclomatic up to {s.max_cyclomatic}, cognitive up to {s.max_cognitive}, median {s.median_cyclomatic:g}"]
    return lines + [f"{key}: {_value(values.get(key))}" for key in ratchet.AGGREGATES] + report.notes


def render_hotspots(report: Report, k: int) -> list[str]:
    if report.hotspots is None:
        return ["no hotspots: " + "; ".join(report.notes)]
    return [f"{r.score:8} {r.file} ({r.commits} changes)" for r in churn.top_hotspots(report.hotspots, k).collect()]


def render_compare(verdicts: DataFrame) -> list[str]:
    rows = verdicts.collect()
    worse = [r for r in rows if r.verdict in ratchet.REGRESSIONS]
    lines = [f"{r.verdict}: {r.key} {_value(r.before)} -> {_value(r.after)}" for r in sorted(worse, key=lambda r: r.key)]
    lines += [f"{r.key} rises, but what it is a share of has shrunk" for r in rows if r.verdict == "diluted"]
    count = lambda *names: sum(r.verdict in names for r in rows)
    return [*lines, f"{len(worse)} worse, {count('improvement')} better, {count('unchanged', 'diluted')} unchanged, {count('skipped')} not measured on both sides"]


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="codestrata")
    out.add_argument("command", choices=["scan", "file", "baseline", "check", "hotspots", "explain"])
    out.add_argument("path", nargs="?")
    out.add_argument("--root", default=".")
    out.add_argument("--json", action="store_true")
    out.add_argument("--all", action="store_true")
    out.add_argument("--no-git", action="store_true")
    out.add_argument("--no-tools", action="store_true")
    out.add_argument("--since")
    out.add_argument("--limit", type=int, default=20)
    out.add_argument("--top", type=int, default=10)
    out.add_argument("--baseline")
    return out


def _show(args, lines: Callable[[], list[str]], table: Callable[[], DataFrame]) -> None:
    print("\n".join(r.value for r in table().select(F.to_json(F.struct("*")).alias("value")).collect()) if args.json else "\n".join(lines()))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
        settings = config.load(args.root)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 3
    except config.ConfigError as e:
        print(e, file=sys.stderr)
        return 3
    if args.command in ("file", "explain") and not args.path:
        print(f"{args.command} needs a path", file=sys.stderr)
        return 3
    spark = spark or SparkSession.builder.appName("codestrata").getOrCreate()
    root = os.path.abspath(args.root)
    file = os.path.relpath(os.path.abspath(args.path), root).replace(os.sep, "/") if args.path else None
    if args.command == "file":
        found = findings.visible(scan_file(spark, root, file, settings), args.all)
        lines = render_findings(found)
        print("\n".join(lines), file=sys.stderr) if lines else None
        return 2 if lines else 0
    where = os.path.join(root, args.baseline or BASELINE)
    before = None
    if args.command == "check":
        try:
            before = baselines.read(spark, where)
        except baselines.BaselineError as e:
            print(f"{e}: make one with the command baseline", file=sys.stderr)
            return 3
    report = scan(spark, root, settings, git=not args.no_git, tools=not args.no_tools and args.command not in ("hotspots", "explain"), revisions=args.since)
    if args.command == "scan":
        shown = findings.visible(report.findings, args.all)
        _show(args, lambda: [*render_summary(report), "", *render_findings(shown, args.limit)], lambda: report.findings)
        return 0
    if args.command == "hotspots":
        _show(args, lambda: render_hotspots(report, args.top), lambda: report.hotspots if report.hotspots is not None else report.findings.limit(0))
        return 0
    if args.command == "baseline":
        baselines.write(report.snapshot(), where)
        print(f"baseline written to {where}")
        return 0
    if args.command == "explain":
        own = findings.visible(report.findings.where(F.col("file") == file), args.all)
        if report.file_metrics.where(F.col("file") == file).isEmpty():
            print(f"{file} isn't in scope", file=sys.stderr)
            return 3
        lines = render_findings(own)
        print("\n".join(lines or ["no findings"]))
        return 1 if lines else 0
    try:
        verdicts = ratchet.compare(before, report.snapshot())
    except ValueError as e:
        print(f"no comparison: {e}")
        return 1
    worse = not ratchet.regressions(verdicts).isEmpty()
    _show(args, lambda: render_compare(verdicts) + (render_findings(ratchet.findings_behind(report.findings, verdicts), args.limit) if worse else []), lambda: verdicts)
    return int(worse)


if __name__ == "__main__":
    sys.exit(main())
