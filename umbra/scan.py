"""python -m umbra.scan PATH... : look for sensitive data in files.

Exit code 1 with --bail and findings, 2 for a wrong call, else 0.
"""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.operators.parts import scan_files
from umbra.operators.scanning import report, status_table, summary
from umbra.profiles import load, scan_settings
from umbra.sources.allfiles import missing_paths, shared_folder
from umbra.sources.lines import BLOCK, pretty, write_report


def json_lines(results: DataFrame) -> DataFrame:
    """The report's rows as items of a JSON list, in the order of their paths."""

    @F.pandas_udf("string")
    def item(rows):
        return rows.map(lambda r: pretty(json.loads(r)))

    rows = report(results).orderBy("path")
    return rows.select(item(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).alias("line"))


def _printed(spark: SparkSession, lines: DataFrame, **options: str) -> None:
    """Write the report where executors see it, and copy it to the standard output in blocks."""
    folder = os.path.join(shared_folder(spark).removeprefix("file://"), f"umbra-report-{uuid.uuid4().hex}")
    os.makedirs(folder)
    try:
        write_report(lines, f"{folder}/report", **options)
        with open(f"{folder}/report", encoding="utf-8", errors="replace", newline="") as f:
            shutil.copyfileobj(f, sys.stdout, BLOCK)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    settings = scan_settings()
    parser = argparse.ArgumentParser(prog="python -m umbra.scan", description="Scan files and directories for sensitive data.")
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--profile", default=settings["profile"])
    parser.add_argument("--bail", action="store_true", help="exit with 1 if there are findings")
    parser.add_argument("--summary-only", action="store_true")
    parser.add_argument("--output", default="table", choices=["table", "json"])
    parser.add_argument("--compat", action="store_true", help="only the plain replacement is a finding")
    args = parser.parse_args(argv)
    try:
        profile = load(args.profile)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    print(f"Scanning paths: {', '.join(args.paths)} with profile: {args.profile}")
    for path in missing_paths(args.paths):
        print(f"Path not found or not accessible: {path}")
    spark = spark or SparkSession.builder.appName("umbra.scan").getOrCreate()
    results = scan_files(spark, args.paths, profile, settings["exclude_patterns"], settings["max_file_size"], compat=args.compat).persist()
    try:
        counts = summary(results).first()
        if args.output == "json":
            _printed(spark, json_lines(results), head="[\n", between=",\n", tail="\n]\n", empty="[]\n")
        elif not args.summary_only:
            table = status_table(results)
            names = ("Status", "Findings", "File Path")
            found = table.agg(*(F.coalesce(F.max(F.length(c)), F.lit(0)) for c in table.columns)).first()
            widths = [max(len(n), w) for n, w in zip(names, found)]
            rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+\n"
            head = rule + "| " + " | ".join(n.ljust(w) for n, w in zip(names, widths)) + " |\n" + rule
            cells = [F.concat(F.lit("| " if i == 0 else " | "), F.rpad(c, w, " ")) for i, (c, w) in enumerate(zip(table.columns, widths))]
            lines = table.orderBy("file_path").select(F.concat(*cells, F.lit(" |\n")).alias("line"))
            _printed(spark, lines, head=head, tail=rule if counts.files_scanned else "")
        print(f"\nScan complete. Files scanned: {counts.files_scanned}")
        print(f"Files with findings: {counts.files_with_findings}")
    finally:
        results.unpersist()
    return int(args.bail and counts.files_with_findings > 0)


if __name__ == "__main__":
    sys.exit(main())
