"""The outside validator of rebuilt files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import cleaned

TOOL = "verapdf"


def compliant(output: Column) -> Column:
    """What the validator's JSON says: of its first job, else at its top; null where it says nothing or is no JSON."""
    found = F.coalesce(F.get_json_object(output, "$.jobs[0].validationResult.isCompliant"), F.get_json_object(output, "$.validationResult.isCompliant"))
    return F.when(found.isNotNull(), ~F.lower(found).isin("false", "0", ""))


def outcome(runs: DataFrame) -> DataFrame:
    """(path, status, passed, details) of runs (path, code, output, errors).

    No code means that the tool is not there: unavailable, passed null. Codes
    other than 0 and 1 are errors, not passed. Else completed, and passed is
    what the output says.
    """
    code = F.col("code")
    failed = ~code.isin(0, 1)
    status = F.when(code.isNull(), "unavailable").when(failed, "error").otherwise("completed")
    passed = F.when(failed, F.lit(False)).when(code.isNotNull(), compliant(F.col("output")))
    details = F.when(code.isNull(), "The validator is not installed; it was not run.").when(failed, F.coalesce(cleaned(F.col("errors")), F.lit("The validator failed."))).otherwise("The validator has run.")
    return runs.select("path", status.alias("status"), passed.alias("passed"), details.alias("details"))


def runs(files: DataFrame, tool: str = TOOL) -> DataFrame:
    """(path, code, output, errors) of the validator over files (path, content), read from its standard input; code is null where the tool is not on the executor's path."""

    def run(batches):
        import shutil
        import subprocess

        import pyarrow as pa

        kind = pa.schema([("path", pa.string()), ("code", pa.int32()), ("output", pa.string()), ("errors", pa.string())])
        there = shutil.which(tool)
        for b in batches:
            rows = []
            for path, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                row = {"path": path, "code": None, "output": None, "errors": None}
                if there:
                    done = subprocess.run([there, "--format", "json"], input=raw or b"", capture_output=True, check=False)
                    row |= {"code": done.returncode, "output": done.stdout.decode(errors="replace"), "errors": done.stderr.decode(errors="replace")}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, kind)

    return files.select("path", "content").mapInArrow(run, "path string, code int, output string, errors string")
