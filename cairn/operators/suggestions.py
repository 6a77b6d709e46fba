"""Suggestions: one for each issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import cleaned, strip

#: The action for each issue type; others are for manual_review.
ACTIONS = {
    "missing_document_title": "set_document_title",
    "missing_document_language": "set_document_language",
    "untagged_pdf": "rebuild_pdf_tags",
    "unknown_pdf_tagging": "manual_review",
    "encrypted_pdf": "manual_review",
    "no_extractable_pdf_text": "request_ocr",
    "missing_image_alt_text": "generate_alt_text",
    "weak_link_text": "improve_link_text",
    "skipped_heading_level": "adjust_heading_level",
    "missing_heading_structure": "confirm_reading_order",
    "missing_table_headers": "confirm_table_headers",
    "multi_column_reading_order_review": "confirm_reading_order",
    "low_reading_order_confidence": "confirm_reading_order",
}
#: Issue types whose suggestions a model may word, and those that belong to one element.
AI_ASSISTED = ["missing_image_alt_text", "weak_link_text", "missing_heading_structure"]
SCOPED = ["missing_image_alt_text", "weak_link_text", "missing_table_headers", "low_reading_order_confidence", "skipped_heading_level"]
#: Proposed texts.
CONFIRM_ORDER = "Confirm the correct reading order and section structure before PDF rebuild."
CONFIRM_HEADERS = "Confirm the first row or column that should be treated as table headers."
DESCRIBE_IMAGE = "Describe the meaningful content or purpose of this image."
REPLACE_LINK = "Replace with descriptive link text."
REBUILD_TAGS = "Rebuild PDF logical structure tree from the internal document model."
RUN_OCR = "Run OCR before remediation."
LANGUAGE = "en-AU"


def action(issue_type: Column) -> Column:
    known = F.lit(None).cast("string")
    for kind, name in ACTIONS.items():
        known = F.when(issue_type == kind, name).otherwise(known)
    return F.coalesce(known, F.lit("manual_review"))


def source(issue_type: Column) -> Column:
    return F.when(issue_type.isin(AI_ASSISTED), "ai_assisted").otherwise("rule")


def authority(href: Column) -> Column:
    """Network location of a link, or the link itself."""
    return F.coalesce(F.nullif(F.try_parse_url(href, F.lit("AUTHORITY")), F.lit("")), href)


def first_match(issues: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, issue_ord, match_pos): the first element that is an issue's by id, by page and box, or by its whole source.

    The three ways are equi-joins of their own; of all matches the first stays.
    Where both tables have a description, it is part of the whole source.
    """
    described = ["description"] if "description" in issues.columns and "description" in elements.columns else []
    e = elements.select(F.col("doc_id"), F.col("pos").alias("match_pos"), *[F.col(c).alias(f"e_{c}") for c in ("element_id", "page_number", "x0", "y0", "x1", "y1", *described)])
    place = [F.col(c) == F.col(f"e_{c}") for c in ("page_number", "x0", "y0", "x1", "y1")]
    same = [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in ("element_id", "page_number", "x0", "y0", "x1", "y1", *described)]
    keep = ["doc_id", "issue_ord", "match_pos"]
    i = issues.select("doc_id", "issue_ord", "issue_type", "element_id", "page_number", "x0", "y0", "x1", "y1", *described)

    def on(rows, terms):
        left = rows.withColumnRenamed("doc_id", "i_doc")
        cond = F.col("i_doc") == F.col("doc_id")
        for t in terms:
            cond = cond & t
        return left.join(e, cond).select(*keep)

    ways = on(i.filter(cleaned(F.col("element_id")).isNotNull()), [F.col("element_id") == F.col("e_element_id")])
    ways = ways.unionByName(on(i.filter(F.col("page_number") > 0), place)).unionByName(on(i.filter(F.col("issue_type").isin(SCOPED)), same))
    return ways.groupBy("doc_id", "issue_ord").agg(F.min("match_pos").alias("match_pos"))


def own_match(elements: DataFrame) -> DataFrame:
    """elements with match (pos, text, href, nearby_text): the element that first_match finds for an issue of SCOPED types that is the element's own.

    The three ways are windows within a document, so elements that are dealt by document are not dealt again.
    """
    it = F.struct("pos", "text", "href", "nearby_text")
    place = ["page_number", "x0", "y0", "x1", "y1"]
    first = lambda *by: F.min(it).over(Window.partitionBy("doc_id", *by))
    placed = F.col("page_number") > 0
    for c in place[1:]:
        placed = placed & F.col(c).isNotNull()
    by_id = F.when(cleaned(F.col("element_id")).isNotNull(), first("element_id"))
    return elements.withColumn("match", F.least(first("element_id", *place), by_id, F.when(placed, first(*place))))


def element_value(t: Column, suggested_fix: Column, text: Column, href: Column, nearby_text: Column) -> Column:
    """What is proposed for an issue of type t, from the text, link and text nearby of the element that it matches."""
    near = cleaned(nearby_text)
    context = F.coalesce(F.substring(near, 1, 160), cleaned(F.substring(strip(text), 1, 160)))
    return (
        F.when(t == "missing_image_alt_text", F.coalesce(F.concat(F.lit("Image related to: "), context), F.lit(DESCRIBE_IMAGE)))
        .when((t == "weak_link_text") & cleaned(href).isNotNull(), F.coalesce(F.substring(near, 1, 80), F.concat(F.lit("Open "), authority(href))))
        .when(t == "weak_link_text", F.lit(REPLACE_LINK))
        .when(t == "missing_table_headers", F.lit(CONFIRM_HEADERS))
        .when(t.isin("missing_heading_structure", "multi_column_reading_order_review", "low_reading_order_confidence"), F.lit(CONFIRM_ORDER))
        .otherwise(suggested_fix)
    )


def suggest(issues: DataFrame, elements: DataFrame) -> DataFrame:
    """One suggestion per issue: action, source, proposed_value, requires_user_confirmation, confidence."""
    e = elements.select("doc_id", F.col("pos").alias("match_pos"), F.col("text").alias("e_text"), "href", "nearby_text")
    rows = issues.join(first_match(issues, elements), ["doc_id", "issue_ord"], "left").join(e, ["doc_id", "match_pos"], "left")
    t = F.col("issue_type")
    rows = rows.withColumn("proposed_value", element_value(t, F.col("suggested_fix"), F.col("e_text"), F.col("href"), F.col("nearby_text")))
    return rows.select("doc_id", "issue_ord", "issue_type", action(t).alias("action"), source(t).alias("source"), "match_pos", "proposed_value", (F.col("automation_status") != "auto_fixable").alias("requires_user_confirmation"), confidence(F.col("confidence"), F.col("proposed_value"), F.col("automation_status")).alias("confidence"))


def confidence(c: Column, proposed_value: Column, automation_status: Column) -> Column:
    return F.when(cleaned(proposed_value).isNull(), F.least(c, F.lit(0.4))).when(automation_status == "auto_fixable", F.greatest(c, F.lit(0.85))).otherwise(c)


def document_value(t: Column, suggested_fix: Column, metadata_language: Column, first_text: Column) -> Column:
    """What is proposed for an issue of type t of a whole document."""
    fix = F.nullif(suggested_fix, F.lit(""))
    return (
        F.when(t == "missing_document_title", F.coalesce(fix, first_text))
        .when(t == "missing_document_language", F.coalesce(F.nullif(metadata_language, F.lit("")), F.lit(LANGUAGE)))
        .when(t == "untagged_pdf", F.lit(REBUILD_TAGS))
        .when(t == "no_extractable_pdf_text", F.lit(RUN_OCR))
        .when(t == "multi_column_reading_order_review", F.lit(CONFIRM_ORDER))
        .otherwise(suggested_fix)
    )


def document_suggestions(issues: DataFrame, documents: DataFrame, texts: DataFrame) -> DataFrame:
    """Suggestions for issues of documents and inspections (doc_id, issue_type, suggested_fix, confidence, automation_status).

    documents: (doc_id, metadata_language); texts: (doc_id, first_text).
    """
    rows = issues.join(documents, "doc_id", "left").join(texts, "doc_id", "left")
    t = F.col("issue_type")
    rows = rows.withColumn("proposed_value", document_value(t, F.col("suggested_fix"), F.col("metadata_language"), F.col("first_text")))
    return rows.select("doc_id", "issue_type", action(t).alias("action"), source(t).alias("source"), "proposed_value", (F.col("automation_status") != "auto_fixable").alias("requires_user_confirmation"), confidence(F.col("confidence"), F.col("proposed_value"), F.col("automation_status")).alias("confidence"))


def explanation(reason: Column, action: Column, value: Column) -> Column:
    """Why, and what is proposed or that someone has to look."""
    return F.concat(reason, F.when(cleaned(value).isNotNull(), F.concat(F.lit(" Suggested step: "), action, F.lit("."))).otherwise(F.lit(" Nothing can be suggested; please look at it yourself.")))
