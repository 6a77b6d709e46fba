"""Whole analyses: every issue of a document in one order, its suggestions and audit rows, and the report that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import strip
from cairn.operators import rules, service, suggestions

#: The standard that is held to, and rules and confidences of issues of whole documents.
TARGET = "WCAG 2.2 AA"
DOCUMENT_RULES = {"missing_document_title": ("wcag.document.title", 0.6), "missing_document_language": ("wcag.document.language", 0.7), "missing_heading_structure": ("wcag.headings.present", 0.75)}
STATEMENT = "These are automated checks; they do not say whether a document meets the law."
PLACE = ["element_id", "page_number", "x0", "y0", "x1", "y1"]


def issues(documents: DataFrame, inspections: DataFrame, elements: DataFrame) -> DataFrame:
    """Every issue of documents (doc_id, title, language): of inspections, of whole documents, then of elements; issue_ord counts them.

    (doc_id, issue_ord, part, at, rule_id, issue_type, severity, confidence,
    automation_status, suggested_fix, pages, pos, element_id, page_number, x0,
    y0, x1, y1); part is 0 to 2, at the place in it. Open until decided.
    """
    none = lambda kind: F.lit(None).cast(kind)
    nowhere = [none("long").alias("pos"), none("string").alias("element_id"), none("long").alias("page_number"), *[none("double").alias(c) for c in PLACE[2:]]]
    judged = ["rule_id", "issue_type", "severity", "confidence", "automation_status"]
    pdf = rules.inspection_issues(inspections).filter("issue_type <> 'missing_document_language'")
    pdf = pdf.select("doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), *judged, none("string").alias("suggested_fix"), "pages", *nowhere)
    kind = F.col("issue_type")
    rule, sure = _document_rule(kind, F.col("automation_status"))
    title = F.when(kind == "missing_document_title", F.col("first_text"))
    whole = service.document_issues(documents, elements).join(rules.first_text(elements), "doc_id", "left").withColumn("rule_id", rule).withColumn("confidence", sure)
    whole = whole.select("doc_id", F.lit(1).alias("part"), F.col("rank").cast("long").alias("at"), *judged, title.alias("suggested_fix"), none("string").alias("pages"), *nowhere)
    single = rules.element_issues(elements).select("doc_id", F.lit(2).alias("part"), F.col("issue_ord").alias("at"), *judged, "suggested_fix", none("string").alias("pages"), "pos", *PLACE)
    order = Window.partitionBy("doc_id").orderBy("part", "at", "issue_type")
    every = pdf.unionByName(whole).unionByName(single)
    return every.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("issue_ord"), *[c for c in every.columns if c != "doc_id"])


def _document_rule(kind: Column, status: Column) -> tuple[Column, Column]:
    """The rule and confidence of an issue of a whole document."""
    rule, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, (r, c) in DOCUMENT_RULES.items():
        rule, sure = F.when(kind == name, r).otherwise(rule), F.when(kind == name, c).otherwise(sure)
    return rule, F.when(status == rules.AUTO, 0.85).otherwise(sure)


def suggested(found: DataFrame, elements: DataFrame, languages: DataFrame) -> DataFrame:
    """A suggestion for each of issues(): (doc_id, issue_ord, issue_type, action, source, proposed_value, requires_user_confirmation, confidence).

    languages: (doc_id, metadata_language), what a file's metadata says.
    """
    cols = ["issue_type", "action", "source", "proposed_value", "requires_user_confirmation", "confidence"]
    single = suggestions.suggest(found.filter("part = 2"), elements).select("doc_id", "issue_ord", *cols)
    whole = found.filter("part < 2")
    made = suggestions.document_suggestions(whole, languages, rules.first_text(elements))  # a type once in a document
    return single.unionByName(whole.select("doc_id", "issue_type", "issue_ord").join(made, ["doc_id", "issue_type"]).select("doc_id", "issue_ord", *cols))


def counted(values: Column) -> Column:
    """How often each of a list's few different values is in it, as a map."""
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.struct(v, F.size(values) - F.size(F.array_remove(values, v)))))


def _idea(kind: Column, value: Column, confidence: Column, status: Column) -> Column:
    """A suggestion as reports hold it, without issue_ord."""
    action = suggestions.action(kind)
    why = suggestions.explanation(F.concat(F.lit("Found: "), kind, F.lit(".")), action, value)
    return F.struct(action.alias("action"), suggestions.source(kind).alias("source"), value.alias("proposed_value"), why.alias("explanation"), (status != rules.AUTO).alias("requires_user_confirmation"), suggestions.confidence(confidence, value, status).alias("confidence"))


def _numbered(items: Column, part: str, fields: Sequence[str]) -> Column:
    """A part of a list's structs with issue_ord, their place in it."""
    return F.transform(items, lambda x, i: F.struct(i.cast("long").alias("issue_ord"), *[x[part][f].alias(f) for f in fields]))


ISSUE = ["rule_id", "issue_type", "severity", "source", "suggested_fix", "confidence", "automation_status", "final_status"]
IDEA = ["action", "source", "proposed_value", "explanation", "requires_user_confirmation", "confidence"]


def reports_within(documents: DataFrame, elements: DataFrame, at: Column) -> DataFrame:
    """(doc_id, report): issues, suggestions and reports of documents in one go, the same as issues(), suggested() and whole_reports() give by tables.

    documents: (doc_id, file, format, title, language, metadata_language, pdf) and,
    for jobs, (job_id, status, created_at, updated_at, artifacts); pdf is a struct
    of an inspection. Every step is by document, so where both tables are dealt by
    doc_id into as many partitions, nothing is dealt or written again.
    """
    rows = rules.with_level_before(suggestions.own_match(elements))
    rows = rows.select("doc_id", "pos", "type", "text", *PLACE, F.struct("match.text", "match.href", "match.nearby_text").alias("m"), rules.found_in_element().alias("found"))
    rows = rows.select("*", F.posexplode_outer("found").alias("nth", "i")).drop("found")
    kind, fix = F.col("i.issue_type"), F.col("i.suggested_fix")
    rows = rows.withColumn("value", suggestions.element_value(kind, fix, F.col("m.text"), F.col("m.href"), F.col("m.nearby_text")))
    box = F.when(F.col("x0").isNotNull(), F.array("x0", "y0", "x1", "y1"))
    none = F.lit(None).cast("string")
    issue = F.struct("i.rule_id", "i.issue_type", "i.severity", F.struct("element_id", "page_number", box.alias("bbox"), none.alias("description")).alias("source"), "i.suggested_fix", "i.confidence", "i.automation_status", F.lit("open").alias("final_status"))
    idea = _idea(kind, F.col("value"), F.col("i.confidence"), F.col("i.automation_status"))
    one = F.struct((F.col("i.stage") > 0).alias("later"), "pos", F.col("i.stage").alias("stage"), issue.alias("issue"), idea.alias("suggestion"))  # in the order of issues
    first = F.coalesce(F.col("nth"), F.lit(0)) == 0  # an element with several issues has several rows
    text = strip(F.col("text"))
    per = rows.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("i").isNotNull(), one)).alias("single"), F.min_by(F.substring(text, 1, 80), F.when(text != "", F.col("pos"))).alias("first_text"),
        ((F.count_if(first & (F.col("type") == "heading")) == 0) & (F.count_if(first & (F.col("type") == "paragraph")) >= rules.FLAT)).alias("flat"),
    )
    rows = documents.join(per, "doc_id", "left")
    of = lambda name: F.col(f"pdf.{name}")
    nowhere = lambda pages: F.struct(none.alias("element_id"), F.lit(None).cast("long").alias("page_number"), F.lit(None).cast("array<double>").alias("bbox"), pages.alias("description")).alias("source")

    def whole(kind, rule, severity, fix, confidence, status, pages):
        kind, empty = F.lit(kind), F.lit(None)
        issue = F.struct(rule.alias("rule_id"), kind.alias("issue_type"), F.lit(severity).alias("severity"), nowhere(pages), fix.alias("suggested_fix"), confidence.alias("confidence"), status.alias("automation_status"), F.lit("open").alias("final_status"))
        value = suggestions.document_value(kind, fix, F.col("metadata_language"), F.col("first_text"))
        return F.struct(empty.cast("boolean").alias("later"), empty.cast("long").alias("pos"), empty.cast("int").alias("stage"), issue.alias("issue"), _idea(kind, value, confidence, status).alias("suggestion"))

    found = []
    for kind, rule, when, severity, sure, status in sorted(rules.inspection_rules(of), key=lambda r: r[0]):
        if kind != "missing_document_language":
            pages = F.array_join(of("multi_column_pages"), ", ") if kind == "multi_column_reading_order_review" else none
            found.append((F.col("pdf").isNotNull() & when, whole(kind, F.lit(rule), severity, none, F.lit(sure), F.lit(status), pages)))
    for kind, severity, status, when in service.document_rules():
        rule, sure = _document_rule(F.lit(kind), status)
        found.append((when, whole(kind, rule, severity, F.col("first_text") if kind == "missing_document_title" else none, sure, status, none)))
    single = per.schema["single"].dataType
    nothing = F.array().cast(single)
    rows = rows.withColumn("whole", rules.those_that_hold(single.elementType.simpleString(), *found)).withColumn("every", F.concat("whole", F.coalesce(F.array_sort("single"), nothing)))
    rows = rows.withColumn("issues", _numbered(F.col("every"), "issue", ISSUE)).withColumn("suggestions", _numbered(F.col("every"), "suggestion", IDEA))
    return _reports(rows, at)


def whole_reports(documents: DataFrame, inspections: DataFrame, found: DataFrame, made: DataFrame, at: Column, jobs: DataFrame | None = None) -> DataFrame:
    """(doc_id, report): each document's whole report as a VARIANT value.

    documents: (doc_id, file, format); found and made as issues() and suggested()
    give them, with final_status where issues have one; jobs: (doc_id, job_id,
    status, created_at, updated_at, artifacts). Parts: file, target,
    generated_at, source, summary, issues, suggestions, audit_events and, with
    jobs, job and output_artifacts. Issues and suggestions meet in one exchange;
    documents without any have empty lists.
    """
    box = F.when(F.col("x0").isNotNull(), F.array("x0", "y0", "x1", "y1"))
    status = F.col("final_status") if "final_status" in found.columns else F.lit("open")
    issue = F.struct("issue_ord", "rule_id", "issue_type", "severity", F.struct("element_id", "page_number", box.alias("bbox"), F.col("pages").alias("description")).alias("source"), "suggested_fix", "confidence", "automation_status", status.alias("final_status"))
    idea = F.struct("issue_ord", "action", "source", "proposed_value", suggestions.explanation(F.concat(F.lit("Found: "), "issue_type", F.lit(".")), F.col("action"), F.col("proposed_value")).alias("explanation"), "requires_user_confirmation", "confidence")
    issue_rows, idea_rows = found.select("doc_id", issue.alias("issue")), made.select("doc_id", idea.alias("suggestion"))
    both = issue_rows.unionByName(idea_rows, allowMissingColumns=True).groupBy("doc_id").agg(F.sort_array(F.collect_list("issue")).alias("issues"), F.sort_array(F.collect_list("suggestion")).alias("suggestions"))
    rows = documents.join(both, "doc_id", "left").join(inspections.select("doc_id", F.struct(*[c for c in inspections.columns if c != "doc_id"]).alias("pdf")), "doc_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(both.schema[c].dataType))
    rows = rows.withColumn("issues", empty("issues")).withColumn("suggestions", empty("suggestions"))
    return _reports(rows if jobs is None else rows.join(jobs, "doc_id"), at)


def _reports(rows: DataFrame, at: Column) -> DataFrame:
    """Reports of rows (doc_id, file, format, pdf, issues, suggestions) and, for jobs, their columns."""
    of = lambda c: counted(F.transform("issues", lambda x: x[c]))
    summary = F.struct(F.size("issues").alias("initial_issue_count"), F.size("suggestions").alias("suggestion_count"), of("automation_status").alias("automation_status_counts"), of("severity").alias("severity_counts"), of("issue_type").alias("issue_type_counts"), F.lit(STATEMENT).alias("validation_statement"))
    event = lambda s: F.struct(F.lit("suggestion_created").alias("type"), s["issue_ord"].alias("issue_ord"), F.struct(s["action"].alias("action"), s["source"].alias("source"), s["requires_user_confirmation"].alias("requires_user_confirmation")).alias("metadata"))
    parts = [F.col("file"), F.lit(TARGET).alias("target"), at.cast("string").alias("generated_at"), F.struct("format", "pdf").alias("source"), summary.alias("summary"), F.col("issues"), F.col("suggestions"), F.transform("suggestions", event).alias("audit_events")]
    if "job_id" in rows.columns:
        parts += [F.struct(F.col("job_id").alias("id"), "status", "created_at", "updated_at").alias("job"), F.col("artifacts").alias("output_artifacts")]
    return rows.select("doc_id", F.to_variant_object(F.struct(*parts)).alias("report"))


def listed(reports: DataFrame, part: str, fields: dict[str, str]) -> DataFrame:
    """(doc_id, ord, *fields) of a report's list; fields are paths by name and type, such as {"severity": "string"}."""
    each = reports.sparkSession.sql("SELECT doc_id, e.pos AS ord, e.value AS v FROM {r}, LATERAL variant_explode(variant_get(report, '$." + part + "', 'variant')) AS e", r=reports)
    return each.select("doc_id", F.col("ord").cast("long").alias("ord"), *[F.variant_get("v", f"$.{name}", kind).alias(name.replace(".", "_")) for name, kind in fields.items()])


def texts(reports: DataFrame, name: Column) -> DataFrame:
    """(name, text): reports as JSON for files."""
    return reports.select(name.alias("name"), F.to_json("report").alias("text"))
