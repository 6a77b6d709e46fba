"""Decisions, the audit log and job status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import cleaned, strip


class ReviewError(ValueError):
    """A decision refers to a suggestion or issue that is not there, or to two that do not belong together."""


def status_for(decision: Column) -> Column:
    return F.when(decision.isin("accept", "edit"), "accepted").when(decision == "reject", "rejected")


def latest(decisions: DataFrame) -> DataFrame:
    """The last decision for each suggestion, as status."""
    last = decisions.groupBy("job_id", "slot").agg(F.max_by("decision", "seq").alias("decision"), F.max("seq").alias("seq"))
    return last.withColumn("final_status", status_for(F.col("decision")))


def unknown(decisions: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Decisions whose (job_id, slot) no suggestion has."""
    return decisions.join(suggestions, ["job_id", "slot"], "left_anti")


def problems(decisions: DataFrame, suggestions: DataFrame, issues: DataFrame) -> DataFrame:
    """(job_id, seq, problem) of decisions (job_id, seq, slot, issue): unknown suggestion, one of another issue, or unknown issue.

    suggestions: (job_id, slot, of_issue); issues: (job_id, issue).
    """
    known = issues.select("job_id", "issue").distinct().withColumn("there", F.lit(True))
    rows = decisions.join(suggestions.select("job_id", "slot", "of_issue"), ["job_id", "slot"], "left").join(known, ["job_id", "issue"], "left")
    problem = F.when(F.col("of_issue").isNull(), "unknown suggestion").when(F.col("of_issue") != F.col("issue"), "mismatch").when(F.col("there").isNull(), "unknown issue")
    return rows.select("job_id", "seq", problem.alias("problem")).filter("problem is not null")


def message(decision: Column) -> Column:
    """What the audit log says of a decision."""
    return F.when(decision == "accept", "The suggestion was taken as it is.").when(decision == "edit", "The suggestion was taken with changes.").when(decision == "reject", "The suggestion was turned down.")


def apply_decisions(issues: DataFrame, decisions: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """Issues (job_id, slot, ...) with final_status, open where no decision knows them; all or nothing.

    A reference to an unknown suggestion raises. With suggestions (job_id, slot,
    of_issue), and an issue in issues and decisions, so do one to an unknown
    issue and one to another issue than the suggestion's.
    """
    if suggestions is None:
        wrong = unknown(decisions, issues.select("job_id", "slot")).select("job_id", F.lit("unknown suggestion").alias("problem"))
    else:
        wrong = problems(decisions, suggestions, issues)
    found = wrong.first()
    if found:
        raise ReviewError(f"{found['problem']} in a decision of job {found['job_id']}")
    return issues.drop("final_status").join(latest(decisions).select("job_id", "slot", "final_status"), ["job_id", "slot"], "left").withColumn("final_status", F.coalesce("final_status", F.lit("open")))


def audit_rows(decisions: DataFrame, base: int = 0) -> DataFrame:
    """An audit row for each decision, in order behind the `base` rows that are there."""
    return decisions.select("job_id", (F.lit(base) + F.col("seq")).cast("long").alias("event_seq"), F.lit("user_decision_recorded").alias("type"), "slot", "decision", "final_value")


def resolved_values(decisions: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Latest accepted value of each (job_id, slot): the final value, else the proposed one; a later reject does not cancel it."""
    rows = decisions.filter(F.col("decision").isin("accept", "edit")).join(suggestions, ["job_id", "slot"])
    rows = rows.withColumn("v", F.coalesce(cleaned(F.col("final_value")), F.nullif("proposed_value", F.lit("")))).filter("v is not null")
    return rows.groupBy("job_id", "slot").agg(F.max_by("v", "seq").alias("value"))


def resolved_by_action(decisions: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(job_id, action, value): over a job's whole log, the value of the last accepted or edited suggestion of each action.

    suggestions: (job_id, slot, action, proposed_value); several may have one
    action. A decision without a value of either kind is passed over.
    """
    rows = decisions.filter(F.col("decision").isin("accept", "edit")).join(suggestions, ["job_id", "slot"])
    rows = rows.withColumn("v", F.coalesce(cleaned(F.col("final_value")), F.when(F.col("proposed_value") != "", strip(F.col("proposed_value"))))).filter("v is not null")
    return rows.groupBy("job_id", "action").agg(F.max_by("v", "seq").alias("value"))


def job_status(issues: DataFrame, jobs: DataFrame) -> DataFrame:
    """reviewed where a job has issues and none is open, else awaiting_review; jobs without issues are kept."""
    counts = issues.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("final_status") == "open").alias("open"))
    rows = jobs.join(counts, "job_id", "left")
    return rows.select("job_id", F.coalesce("n", F.lit(0)).cast("long").alias("issues"), F.when((F.col("n") > 0) & (F.col("open") == 0), "reviewed").otherwise("awaiting_review").alias("status"))
