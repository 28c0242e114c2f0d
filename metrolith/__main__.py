"""The command line: analyse files, measure a repository's history, list the catalogue, ask which engines answer."""

from __future__ import annotations

import argparse
import json
import sys

from . import __doc__ as about
from .operators.measure import MetricFrame, doctor, measure
from .plans.specs import SCHEMA_VERSION, catalogue


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="metrolith", description=about or __doc__)
    p.add_argument("--version", action="version", version=f"metrolith, schema {SCHEMA_VERSION}")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyse", help="measure files, folders, or - for standard input")
    a.add_argument("path", nargs="+")
    h = sub.add_parser("history", help="measure revisions of a repository")
    h.add_argument("path", nargs="?", default=".")
    h.add_argument("--limit", type=int, default=100, help="revisions, from the newest")
    h.add_argument("--every", type=int, default=1, help="only each n-th of them")
    h.add_argument("--branch", default="HEAD")
    h.add_argument("--max-files", type=int, default=50, help="of a revision, by name")
    h.add_argument("--trend", help="a metric column to follow over the revisions")
    h.add_argument("--how", default="mean", choices=["mean", "sum", "max", "min", "median", "count"])
    for x in (a, h):
        x.add_argument("--engines", nargs="*", help="names of engines, ours or the customary ones")
        x.add_argument("--include-optional", action="store_true", help="engines that are programs, too")
        x.add_argument("--parquet", metavar="DIR")
        x.add_argument("--csv", metavar="DIR")
    a.add_argument("--summary", action="store_true", help="what engines disagree on, and how often")
    a.add_argument("--threshold", type=float, default=0.10)
    c = sub.add_parser("catalogue", help="all columns as Markdown")
    c.add_argument("--write", metavar="FILE")
    sub.add_parser("doctor", help="which engines answer here").add_argument("--json", action="store_true")
    return p


def _show(frame: MetricFrame, summary: bool) -> None:
    if summary:
        frame.divergence_summary().show(100, False)
    else:
        frame.overview().show(50, False)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        if a.command == "catalogue":
            if a.write:
                with open(a.write, "w", encoding="utf-8") as f:
                    f.write(catalogue())
            else:
                print(catalogue())
            return 0
        if a.command == "doctor":
            rows = doctor()
            if a.json:
                print(json.dumps(rows, indent=2))
            else:
                for r in rows:
                    print(f"{r['engine']:10} {'ok' if r['available'] else 'missing':8} {r['version'] or '':10} {r['path'] or ''}".rstrip())
            return int(any(r["default"] and not r["available"] for r in rows))
        from pyspark.sql import SparkSession

        from .operators.tables import trend
        from .sources.readers import from_strings, measure_history, read_paths

        spark = SparkSession.builder.getOrCreate()
        target, kind = a.parquet or a.csv, "parquet" if a.parquet else "csv"
        if a.command == "history":
            rows = measure_history(spark, a.path, a.engines, include_optional=a.include_optional, limit=a.limit, every=a.every, branch=a.branch, files=a.max_files)
            if a.trend:
                rows = trend(rows, a.trend, a.how)
            if target:
                w = rows.write.mode("overwrite")
                (w.parquet if kind == "parquet" else w.option("header", True).csv)(f"{target}/metrolith_history")
            else:
                rows.orderBy("revision_index").show(50)
            return 0
        given = from_strings(spark, {"<stdin>": sys.stdin.read()}) if a.path == ["-"] else read_paths(spark, *a.path)
        frame = measure(given, a.engines, a.threshold, a.include_optional)
        if target:
            frame.persist().write(target, kind)
        if a.summary or not target:
            _show(frame, a.summary)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
