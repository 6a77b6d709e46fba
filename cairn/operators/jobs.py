"""Jobs: their store, status, files and reports."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.text import stem
from cairn.operators import review

ARTIFACT = "struct<id:string,type:string,filename:string,path:string,created_at:string,validation_report:string>"
SCHEMA = f"job_id long, status string, created_at timestamp, updated_at timestamp, result string, artifacts array<{ARTIFACT}>, version long"
#: What the store itself reads of a job's result; other fields are lost when decisions are applied, so results have these alone.
RESULT = "issues array<struct<slot:long,issue:long,final_status:string>>, suggestions array<struct<slot:long,issue:long,proposed_value:string>>, audit_events array<struct<event_seq:long,type:string,slot:long,decision:string,final_value:string>>"


class JobNotFound(KeyError):
    """There is no such job."""


class JobExists(ValueError):
    """A job of that id is there."""


class Conflict(RuntimeError):
    """Another writer has saved a job since it was read."""


class JobStore:
    """Jobs in Parquet files that never change, in buckets by a hash of their id, and manifests that say which files count.

    A version of the store is a manifest: for each bucket, the folders that hold
    it. A writer puts its new files in a folder of its own and then claims the
    next version's manifest, which only one can. Who comes second takes up the
    other's manifest: buckets that the other left alone stay as prepared, others
    are merged anew, and a job that the other has saved is a Conflict where it
    was read before that. So two writers cannot lose each other's rows, a writer
    that fails leaves the store as it was, and readers of a version see all or
    none of a save. Two jobs' files are never rewritten for a third's sake beyond
    their bucket.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # ------------------------------------------------------------ manifests

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The store's latest version, 0 where nothing was saved."""
        fs, p = self._fs(f"{self.root}/manifests")
        if not fs.exists(p):
            return 0
        return max([0, *(int(x.getPath().getName().removesuffix(".json")) for x in fs.listStatus(p) if x.getPath().getName().endswith(".json"))])

    def manifest(self, version: int) -> dict[int, list[str]]:
        """Folders of each bucket in a version."""
        if not version:
            return {}
        return {int(b): paths for b, paths in json.loads(self._read(f"{self.root}/manifests/{version}.json"))["buckets"].items()}

    def _read(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _claim(self, version: int, buckets: dict[int, list[str]]) -> bool:
        """Make a version's manifest, whole or not at all; False where it is there already."""
        folder, text = f"{self.root}/manifests", json.dumps({"version": version, "buckets": buckets})
        fs, p = self._fs(folder)
        fs.mkdirs(p)
        if fs.getScheme() == "file":
            local = p.toUri().getPath()
            with tempfile.NamedTemporaryFile("w", dir=local, suffix=".new", delete=False) as f:
                f.write(text)
            try:
                os.link(f.name, f"{local}/{version}.json")  # fails where another has made it
            except FileExistsError:
                return False
            finally:
                os.unlink(f.name)
            return True
        jvm = self.spark._jvm
        new = f"{folder}/.{uuid.uuid4().hex}"
        out = self._fs(new)[0].create(self._fs(new)[1])
        out.write(bytearray(text.encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self._fs(new)[1], self._fs(f"{folder}/{version}.json")[1], none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    # -------------------------------------------------------------- reading

    def bucket(self, job_id: Column) -> Column:
        return F.pmod(F.xxhash64(job_id), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The jobs of a version (the latest), of some buckets alone where that is asked for."""
        found = self.manifest(self.version() if version is None else version)
        paths = sorted({p for b, x in found.items() if only is None or b in only for p in x})
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths)

    def get(self, job_id: int, version: int | None = None) -> DataFrame:
        """The job's row, from its bucket's files alone."""
        place = self.spark.range(1).select(self.bucket(F.lit(job_id).cast("long"))).first()[0]
        found = self.read(version, [place]).filter(F.col("job_id") == job_id)
        if found.limit(1).isEmpty():
            raise JobNotFound(job_id)
        return found

    # -------------------------------------------------------------- writing

    def _commit(self, jobs: DataFrame, base: int, fresh: bool, tries: int = 20) -> int:
        """Save rows that were read at version base (fresh: that must not be there); the version that has them."""
        spark, mine = self.spark, jobs.withColumn("bucket", self.bucket(F.col("job_id")))
        staged = f"{self.root}/data/{uuid.uuid4().hex}"
        mine.write.parquet(staged)
        mine = spark.read.schema(mine.schema).parquet(staged)
        repeated = mine.groupBy("job_id").count().filter("count > 1").first()
        if repeated:
            raise JobExists(repeated["job_id"])
        touched = [r[0] for r in mine.select("bucket").distinct().collect()]  # at most as many as there are buckets
        prepared: dict[int, str] = {}
        at, seen = base, {}
        for _ in range(tries):
            latest = self.version()
            known = self.manifest(latest)
            stale = [b for b in touched if b not in prepared or known.get(b) != seen.get(b)]
            if stale:
                there = self.read(latest, stale)
                both = there.join(mine.select("job_id"), "job_id", "left_semi")
                clash = both.filter(F.lit(True) if fresh else F.col("version") > base).first()
                if clash:
                    raise (JobExists if fresh else Conflict)(clash["job_id"])
                if not fresh and (lacking := mine.filter(F.col("bucket").isin(stale)).join(there.select("job_id"), "job_id", "left_anti").first()):
                    raise JobNotFound(lacking["job_id"])
                new = mine.filter(F.col("bucket").isin(stale)).withColumn("version", F.lit(latest + 1).cast("long"))
                kept = there.join(mine.select("job_id"), "job_id", "left_anti").withColumn("bucket", self.bucket(F.col("job_id")))
                folder = f"{self.root}/data/{uuid.uuid4().hex}"
                kept.unionByName(new).repartition("bucket").write.partitionBy("bucket").parquet(folder)
                prepared |= {b: f"{folder}/bucket={b}" for b in stale}
                seen = known
            at = latest + 1
            if self._claim(at, known | {b: [prepared[b]] for b in touched}):
                return at
        raise Conflict(f"no version could be claimed in {tries} tries")

    def create(self, results: DataFrame) -> int:
        """New jobs of (job_id, result), awaiting review; an id that is there, or twice in results, raises."""
        now = F.current_timestamp()
        rows = results.select("job_id", F.lit("awaiting_review").alias("status"), now.alias("created_at"), now.alias("updated_at"), "result", F.array().cast(f"array<{ARTIFACT}>").alias("artifacts"), F.lit(0).cast("long").alias("version"))
        return self._commit(rows, 0, fresh=True)

    def save(self, jobs: DataFrame, base: int) -> int:
        """Replace jobs by rows that were worked out from version base; one that was saved since raises, one that is not there too."""
        return self._commit(jobs.select("job_id", "status", "created_at", F.current_timestamp().alias("updated_at"), "result", "artifacts", "version"), base, fresh=False)

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
        """Save what change makes of the jobs, once more from the latest version where another writer came between."""
        for _ in range(tries):
            base = self.version()
            try:
                return self.save(change(self.read(base)), base)
            except Conflict:
                continue
        raise Conflict(f"other writers came between {tries} times")

    def add_artifacts(self, artifacts: DataFrame) -> int:
        """Append artifacts (job_id, artifact) to their jobs, which then have their output; a job that is not there raises."""
        added = artifacts.groupBy("job_id").agg(F.sort_array(F.collect_list("artifact")).alias("added"))

        def change(jobs: DataFrame) -> DataFrame:
            lacking = added.join(jobs.select("job_id"), "job_id", "left_anti").first()
            if lacking:
                raise JobNotFound(lacking["job_id"])
            return jobs.join(added, "job_id").withColumn("status", F.lit("output_generated")).withColumn("artifacts", F.concat("artifacts", "added"))

        return self.update(change)

    def apply_decisions(self, decisions: DataFrame) -> int | None:
        """Take decisions (job_id, seq, slot, issue, decision, final_value) up into their jobs: statuses of issues, audit rows, the job's status.

        All or nothing: a job that is not there, a suggestion or issue that its
        job has not, or a pair that does not belong together raises and nothing is
        saved. Without decisions nothing is saved either (None).
        """
        if decisions.limit(1).isEmpty():
            return None
        asked = decisions.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("seq", "slot", "issue", "decision", "final_value"))).alias("asked"))

        def change(jobs: DataFrame) -> DataFrame:
            lacking = asked.join(jobs.select("job_id"), "job_id", "left_anti").first()
            if lacking:
                raise JobNotFound(lacking["job_id"])
            rows = jobs.join(asked, "job_id").withColumn("r", F.from_json("result", RESULT))
            of = lambda c: F.coalesce(F.col(f"r.{c}"), F.array().cast(T._parse_datatype_string(RESULT)[c].dataType))
            known = F.transform(of("suggestions"), lambda s: F.struct(s["slot"], s["issue"]))
            there = F.transform(of("issues"), lambda i: i["issue"])
            bad = F.filter("asked", lambda a: ~F.array_contains(known, F.struct(a["slot"], a["issue"])) | ~F.array_contains(there, a["issue"]))
            wrong = rows.filter(F.size(bad) > 0).first()
            if wrong:
                raise review.ReviewError(f"a decision of job {wrong['job_id']} refers to what the job has not")
            last = lambda i: F.get(F.transform(F.slice(F.reverse(F.filter("asked", lambda a: a["issue"] == i["issue"])), 1, 1), lambda a: review.status_for(a["decision"])), F.lit(0))
            issues = F.transform(of("issues"), lambda i: F.struct(i["slot"].alias("slot"), i["issue"].alias("issue"), F.coalesce(last(i), i["final_status"]).alias("final_status")))
            base = F.size(of("audit_events"))
            events = F.transform("asked", lambda a, k: F.struct((base + k + 1).cast("long").alias("event_seq"), F.lit("user_decision_recorded").alias("type"), a["slot"].alias("slot"), a["decision"].alias("decision"), a["final_value"].alias("final_value")))
            rows = rows.withColumn("issues", issues)
            result = F.to_json(F.struct("issues", of("suggestions").alias("suggestions"), F.concat(of("audit_events"), events).alias("audit_events")))
            reviewed = (F.size("issues") > 0) & ~F.exists("issues", lambda i: i["final_status"] == "open")
            return rows.withColumn("result", result).withColumn("status", F.when(reviewed, "reviewed").otherwise("awaiting_review"))

        return self.update(change)


def result_json(issues: DataFrame) -> DataFrame:
    """(job_id, result) of jobs' issues (job_id, slot, issue, proposed_value), all open; each slot is a suggestion of its issue."""
    listed = issues.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("slot", "issue", "proposed_value"))).alias("s"))
    open_ = F.transform("s", lambda x: F.struct(x["slot"].alias("slot"), x["issue"].alias("issue"), F.lit("open").alias("final_status")))
    return listed.select("job_id", F.to_json(F.struct(open_.alias("issues"), F.col("s").alias("suggestions"))).alias("result"))


def opened(jobs: DataFrame) -> DataFrame:
    """jobs with their result's issues, suggestions and audit_events as columns."""
    return jobs.withColumn("r", F.from_json("result", RESULT)).select(*[c for c in jobs.columns if c != "result"], "r.*")


def after_decisions(jobs: DataFrame, issues: DataFrame) -> DataFrame:
    """(job_id, before, after): status is worked out anew, so a job with output goes back to reviewed or awaiting review."""
    return jobs.select("job_id", F.col("status").alias("before")).join(review.job_status(issues, jobs.select("job_id")), "job_id").select("job_id", "before", F.col("status").alias("after"))


def inside(root: Column, path: Column) -> Column:
    """Whether a path, with . and .. taken away, lies below a folder."""
    apart = lambda p: F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    r, p = apart(root), apart(path)
    return (F.size(p) > F.size(r)) & (F.slice(p, 1, F.size(r)) == r)


def report_name(pdf: Column) -> Column:
    """Name of the report that goes with a rebuilt file."""
    return F.concat(F.regexp_replace(stem(pdf), "_accessible$", ""), F.lit("_accessibility_report.json"))


def encode(rows: DataFrame, key: str) -> DataFrame:
    """(key, record): each row's other columns as JSON, nulls too."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key]), {"ignoreNullFields": "false"}).alias("record"))


def decode(records: DataFrame, key: str, schema: str, required: list[str]) -> DataFrame:
    """Rows of encode's records; unknown fields are left out, missing ones null; a record without a required field fails."""
    rows = records.select(key, F.from_json("record", schema).alias("r"), "record")
    lacking = F.array_join(F.filter(F.array(*[F.when(F.col(f"r.{c}").isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull()), ", ")
    checked = F.when(lacking != "", F.raise_error(F.concat(F.lit("record lacks "), lacking))).otherwise(F.col("r"))
    return rows.select(key, checked.alias("r")).select(key, "r.*")


def suggestion_events(suggestions: DataFrame) -> DataFrame:
    """The audit rows of an analysis: one for each suggestion, in order."""
    return suggestions.select("doc_id", F.col("issue_ord").alias("event_seq"), F.lit("suggestion_created").alias("type"), "issue_ord", "action")


def job_report(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """(job_id, report): the document's report under the job's head and artifacts."""
    rows = jobs.join(reports.withColumnRenamed("doc_id", "job_id").withColumnRenamed("report", "validation"), "job_id", "left")
    head = F.struct("job_id", "status", F.coalesce(F.size("artifacts"), F.lit(0)).alias("artifact_count"), "artifacts", F.parse_json(F.coalesce("validation", F.lit("{}"))).alias("validation"))
    return rows.select("job_id", F.to_json(head).alias("report"))
