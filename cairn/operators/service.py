"""What a service or command line around the engine needs: requests as rows, errors as codes, whole analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import strip
from cairn.operators import reports, rules
from cairn.operators.jobs import JobNotFound
from cairn.operators.review import ReviewError

DECISION = "suggestion_id string, issue_id string, decision string, final_value string, reviewer_note string"
REQUIRED = ["suggestion_id", "issue_id", "decision"]
#: The decisions that a reviewer may take.
DECISIONS = ["accept", "edit", "reject"]
#: What the scripted reviewer enters, by action.
SCRIPTED = {
    "set_document_language": "en-AU",
    "generate_alt_text": "A picture that the text beside it describes.",
    "improve_link_text": "Open the page named beside this link",
}


class ArtifactNotFound(KeyError):
    """The job has no such artifact."""


class Unsupported(ValueError):
    """No reader for that kind of document."""


def status_code(error: Exception) -> int:
    """The HTTP status of an error: 415 for files of other kinds, 404 for what is not there, 400 for bad decisions, else 500."""
    if isinstance(error, Unsupported) or "Unsupported document" in str(error):
        return 415
    if isinstance(error, (JobNotFound, ArtifactNotFound)):
        return 404
    return 400 if isinstance(error, ReviewError) else 500


def safe_suffix(name: Column) -> Column:
    """.pdf or .docx where a file name ends so in any case, else nothing."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.endswith(".pdf"), ".pdf").when(low.endswith(".docx"), ".docx").otherwise("")


def media_type(artifact: Column) -> Column:
    return F.when(artifact == "accessibility_report", "application/json").otherwise("application/pdf")


def payload_problem(payload: Column) -> Column:
    """What is wrong with a decision (JSON text): no JSON object, a field lacking or a decision that is none; null where it is in order."""
    r = F.from_json(payload, DECISION)
    lacking = F.array_join(F.filter(F.array(*[F.when(r[c].isNull(), F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull()), ", ")
    broken = ~F.coalesce(strip(payload), F.lit("")).startswith("{") | r.isNull()
    return F.when(broken, "no record").when(lacking != "", F.concat(F.lit("lacks "), lacking)).when(~r["decision"].isin(DECISIONS), "unknown decision")


def artifact(job: DataFrame, artifact_id: str) -> DataFrame:
    """The first artifact of a job's row with an id."""
    found = job.select(F.get(F.filter("artifacts", lambda a: a["id"] == artifact_id), F.lit(0)).alias("a")).filter("a is not null").select("a.*")
    if found.limit(1).isEmpty():
        raise ArtifactNotFound(artifact_id)
    return found.withColumn("media_type", media_type(F.col("type")))


def artifact_label(kind: Column) -> Column:
    """What a page calls an artifact of a kind."""
    return F.when(kind == "accessible_pdf", "Accessible PDF").when(kind == "accessibility_report", "Remediation Report").otherwise(F.replace(kind, F.lit("_"), F.lit(" ")))


def shown_report(artifacts: Column) -> Column:
    """The validation report that a page shows of a job's artifacts: the first file's own, or the one within the first report, whichever comes first.

    Artifacts are structs with type and validation_report (JSON); a blank or null
    report, and a report without one in it, is passed over. JSON text, null where there is none.
    """
    inner = lambda a: F.to_json(F.try_variant_get(F.try_parse_json(a["validation_report"]), "$.validation_report", "variant"))
    own = lambda a: F.when(a["type"] == "accessible_pdf", F.nullif(strip(a["validation_report"]), F.lit(""))).when(a["type"] == "accessibility_report", F.nullif(inner(a), F.lit("null")))
    return F.get(F.filter(F.transform(artifacts, own), lambda x: x.isNotNull()), F.lit(0))


def scripted_decisions(suggestions: DataFrame) -> DataFrame:
    """Suggestions (action, proposed_value, ...) with decision and final_value of the scripted reviewer: an edit where it has a text for the action, else accepted as proposed."""
    own = F.lit(None).cast("string")
    for action, value in SCRIPTED.items():
        own = F.when(F.col("action") == action, F.lit(value)).otherwise(own)
    return suggestions.withColumn("decision", F.when(own.isNotNull(), "edit").otherwise("accept")).withColumn("final_value", F.coalesce(own, "proposed_value", F.lit("")))


def document_rules() -> list[tuple]:
    """(issue_type, severity, automation_status, condition) for a whole document's row (title, language, first_text, flat)."""
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    title = F.when(F.col("first_text").isNotNull(), rules.AUTO).otherwise(rules.CONFIRM)
    return [
        ("missing_document_title", "high", title, blank(F.col("title"))),
        ("missing_document_language", "high", F.lit(rules.CONFIRM), blank(F.col("language"))),
        ("missing_heading_structure", "medium", F.lit(rules.CONFIRM), F.coalesce("flat", F.lit(False))),
    ]


def document_issues(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, rank, issue_type, severity, automation_status) of whole documents (doc_id, title, language): title, language and headings that are missing."""
    none = rules.without_headings(elements).select("doc_id", F.lit(True).alias("flat"))
    rows = documents.select("doc_id", "title", "language").join(rules.first_text(elements), "doc_id", "left").join(none, "doc_id", "left")
    found = rules.those_that_hold("struct<issue_type:string,severity:string,automation_status:string>", *[(when, F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), status.alias("automation_status"))) for kind, severity, status, when in document_rules()])
    return rows.withColumn("found", found).select("doc_id", F.posexplode("found").alias("rank", "i")).select("doc_id", "rank", "i.*")


def analyse(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, report): the report of every document (doc_id, title, language), without elements too; issues of the document come first."""
    whole = document_issues(documents, elements).select("doc_id", F.lit(0).alias("part"), F.col("rank").cast("long").alias("at"), "issue_type", "severity", "automation_status")
    single = rules.element_issues(elements).select("doc_id", F.lit(1).alias("part"), F.col("issue_ord").alias("at"), "issue_type", "severity", "automation_status")
    before = whole.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.when(F.col("part") == 1, F.col("at") + F.coalesce("n", F.lit(0))).otherwise(F.col("at"))
    issues = whole.unionByName(single).join(before, "doc_id", "left").select("doc_id", place.cast("long").alias("issue_ord"), "issue_type", "severity", "automation_status")
    return reports.report_json(documents, issues)


def docx_reports(files: DataFrame, elements: DataFrame) -> DataFrame:
    """(path, report) of word-processor files (path, content) and their scanned elements. Their language is not read and thus reported as missing."""
    null = lambda kind: F.lit(None).cast(kind)
    rows = elements.select(F.col("path").alias("doc_id"), "pos", "type", "text", "heading_level", "element_id", F.lit(1.0).alias("confidence"), null("string").alias("alt_text"), F.lit(False).alias("decorative"), F.lit(0).alias("n_headers"), null("long").alias("page_number"), *[null("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    titles = elements.groupBy(F.col("path").alias("doc_id")).agg(F.max("title").alias("title"))
    documents = files.select(F.col("path").alias("doc_id"), null("string").alias("language")).join(titles, "doc_id", "left")
    return analyse(documents, rows).withColumnRenamed("doc_id", "path")
