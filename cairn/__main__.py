"""Command line: one JSON report for each word-processor file below a path."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from cairn.operators import service
from cairn.sources import files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cairn", description="Analyse documents for accessibility issues.")
    parser.add_argument("path", help="A file or a folder in any store that Spark reads.")
    parser.add_argument("--pretty", action="store_true", help="Indent the reports.")
    parser.add_argument("--out", help="Write the reports there as JSON lines instead of printing them; for many files.")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    found = files.read_files(spark, args.path)
    try:
        if not found.filter("kind = 'pdf'").limit(1).isEmpty():
            raise service.Unsupported("There is no reader for PDF files here.")
        reports = service.docx_reports(found, files.docx_elements(found))
        if args.out:
            reports.write.mode("overwrite").json(args.out)
            return 0
        for row in reports.orderBy("path").toLocalIterator():
            print(json.dumps(json.loads(row["report"]), indent=2 if args.pretty else None))
    except Exception as error:
        if service.status_code(error) != 415:
            raise
        print(f"cairn: {str(error).splitlines()[0]}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
