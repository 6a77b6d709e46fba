"""Rules as data: predicates over elements, documents and inspections that give issues."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.text import cleaned, strip

#: Link texts that say nothing.
GENERIC_LINK_TEXT = ["click here", "here", "link", "learn more", "more", "read more", "view", "download"]
#: Rule, criterion, level, title.
RULES = [
    ("wcag.document.title", "2.4.2", "A", "Page Titled"),
    ("wcag.document.language", "3.1.1", "A", "Language of Page"),
    ("wcag.headings.present", "1.3.1", "A", "Info and Relationships"),
    ("wcag.headings.order", "1.3.1", "A", "Heading Order"),
    ("wcag.images.alt_text", "1.1.1", "A", "Non-text Content"),
    ("wcag.links.meaningful_text", "2.4.4", "A", "Link Purpose"),
    ("wcag.tables.headers", "1.3.1", "A", "Table Relationships"),
    ("wcag.reading_order.confidence", "1.3.2", "A", "Meaningful Sequence"),
    ("pdf.tags.present", "1.3.1", "A", "Tagged PDF Structure"),
    ("pdf.extractable_text", "1.4.5", "AA", "Images of Text"),
    ("pdf.reading_order.multicolumn", "1.3.2", "A", "Multi-column Reading Order"),
    ("pdf.encryption", "4.1.2", "A", "PDF Is Inspectable"),
]
#: Fixed value: so many paragraphs without a heading are an issue.
FLAT = 4
CONFIRM, AUTO, NEVER = "needs_user_confirmation", "auto_fixable", "cannot_automate"


def rules_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, criterion string, level string, title string")


def weak_link(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    short = F.length(t) <= max(map(len, GENERIC_LINK_TEXT))  # lower case is dear and makes no text shorter: taken once, and last
    return (t == "") | t.rlike(r"(?i)^(https?://|www\.)") | (short & F.lower(t).isin(GENERIC_LINK_TEXT))


def missing_alt() -> Column:
    return (F.col("type") == "image") & ~F.col("decorative") & cleaned(F.col("alt_text")).isNull()


def no_headers() -> Column:
    return (F.col("type") == "table") & (F.col("n_headers") == 0)


@dataclass(frozen=True)
class Rule:
    """A rule of a user's own over the columns of an element and level_before; texts are SQL expressions.

    A confidence may be a number, a suggested_fix a Column. Issues come behind
    the built-in ones of an element, in the order of the rules.
    """

    rule_id: str
    issue_type: str
    when: Column | str
    severity: str = "medium"
    confidence: Column | str | float = "confidence"
    automation_status: str = CONFIRM
    suggested_fix: Column | str | None = None


def _column(value: Column | str | float | None) -> Column:
    return value if isinstance(value, Column) else F.expr(value) if isinstance(value, str) else F.lit(value)


def with_level_before(elements: DataFrame) -> DataFrame:
    """elements with the level of the last heading before each, as level_before."""
    by_pos = Window.partitionBy("doc_id").orderBy("pos")
    return elements.withColumn("level_before", F.last(_level(), ignorenulls=True).over(by_pos.rowsBetween(Window.unboundedPreceding, -1)))


def _level() -> Column:
    return F.when(F.col("type") == "heading", F.col("heading_level"))


def those_that_hold(kind: str, *found: tuple[Column, Column]) -> Column:
    """Of (condition, struct of kind), the structs whose condition holds, as an array in their order; without a lambda, which is not compiled."""
    return F.concat(*[F.when(when, F.array(what)).otherwise(F.array().cast(f"array<{kind}>")) for when, what in found])


def found_in_element(more: Sequence[Rule] = ()) -> Column:
    """Issues of an element's row with level_before: an array of (stage, rule_id, issue_type, severity, confidence, automation_status, suggested_fix)."""
    level = _level()

    def issue(stage, rule, kind, when, severity, confidence, fix, status=CONFIRM):
        return when, F.struct(F.lit(stage).alias("stage"), F.lit(rule).alias("rule_id"), F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), confidence.alias("confidence"), F.lit(status).alias("automation_status"), fix.alias("suggested_fix"))

    none, own = F.lit(None).cast("string"), F.col("confidence")
    return those_that_hold(
        "struct<stage:int,rule_id:string,issue_type:string,severity:string,confidence:double,automation_status:string,suggested_fix:string>",
        issue(0, "wcag.headings.order", "skipped_heading_level", level > F.col("level_before") + 1, "medium", F.lit(0.9), F.concat(F.lit("Review whether this should be H"), F.col("level_before") + 1, F.lit("."))),
        issue(1, "wcag.images.alt_text", "missing_image_alt_text", missing_alt(), "high", own, none),
        issue(1, "wcag.links.meaningful_text", "weak_link_text", (F.col("type") == "link") & weak_link(F.col("text")), "medium", F.lit(0.9), none),
        issue(1, "wcag.tables.headers", "missing_table_headers", no_headers(), "high", own, none),
        issue(2, "wcag.reading_order.confidence", "low_reading_order_confidence", own < 0.6, "medium", own, none),
        *[issue(3 + k, r.rule_id, r.issue_type, _column(r.when), r.severity, _column(r.confidence).cast("double"), _column(r.suggested_fix).cast("string"), r.automation_status) for k, r in enumerate(more)],
    )


def element_issues(elements: DataFrame, more: Sequence[Rule] = ()) -> DataFrame:
    """Issues of single elements and of heading order, in one pass: an array of those that hold, exploded.

    issue_ord counts a document's issues: headings first, then element by
    element. Rules of `more` become entries of the same array, so they cost
    neither a scan nor an exchange; a rule_id and issue_type of two rules raise.
    """
    if len({(r.rule_id, r.issue_type) for r in more}) < len(more):
        raise ValueError("two rules have one rule_id and issue_type")
    rows = with_level_before(elements)
    rows = rows.withColumn("found", found_in_element(more)).withColumn("issue", F.explode("found")).drop("found")
    order = Window.partitionBy("doc_id").orderBy((F.col("issue.stage") > 0).cast("int"), "pos", "issue.stage")
    issues = rows.select("doc_id", "pos", "element_id", "page_number", "x0", "y0", "x1", "y1", "issue.*", (F.row_number().over(order) - 1).cast("long").alias("issue_ord"))
    return issues.drop("stage")


def without_headings(elements: DataFrame) -> DataFrame:
    counts = elements.groupBy("doc_id").agg(F.count_if(F.col("type") == "heading").alias("headings"), F.count_if(F.col("type") == "paragraph").alias("paragraphs"))
    return counts.filter((F.col("headings") == 0) & (F.col("paragraphs") >= FLAT)).select("doc_id", F.col("paragraphs").cast("long").alias("paragraphs"))


def first_text(elements: DataFrame) -> DataFrame:
    """First non-blank text of each document, cut to 80 characters."""
    return elements.filter(strip(F.col("text")) != "").groupBy("doc_id").agg(F.substring(strip(F.min_by("text", "pos")), 1, 80).alias("first_text"))


def is_tagged(of: Callable[[str], Column] = F.col) -> Column:
    a, b = of("has_struct_tree"), of("mark_info_marked")
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False)))


def inspection_rules(of: Callable[[str], Column] = F.col) -> list[tuple]:
    """(issue_type, rule_id, condition, severity, confidence, automation_status) for an inspection whose columns `of` gives; encryption hides the rest."""
    tagged, open_ = is_tagged(of), ~of("is_encrypted")
    return [
        ("encrypted_pdf", "pdf.encryption", of("is_encrypted"), "critical", 1.0, NEVER),
        ("untagged_pdf", "pdf.tags.present", open_ & (tagged == F.lit(False)), "critical", 0.95, AUTO),
        ("unknown_pdf_tagging", "pdf.tags.present", open_ & tagged.isNull(), "high", 0.5, CONFIRM),
        ("no_extractable_pdf_text", "pdf.extractable_text", open_ & (of("page_count") > 0) & (of("text_block_count") == 0), "critical", 0.9, CONFIRM),
        ("multi_column_reading_order_review", "pdf.reading_order.multicolumn", open_ & (F.size(of("multi_column_pages")) > 0), "high", 0.75, CONFIRM),
        ("missing_document_language", "wcag.document.language", cleaned(of("language")).isNull(), "high", 0.7, CONFIRM),
    ]


def inspection_issues(pdf: DataFrame) -> DataFrame:
    """(doc_id, issue_type, rule_id, severity, confidence, automation_status, pages) of inspections."""
    found = F.array(*[F.when(when, F.struct(F.lit(t).alias("issue_type"), F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.lit(c).alias("confidence"), F.lit(a).alias("automation_status"))) for t, r, when, s, c, a in inspection_rules()])
    rows = pdf.withColumn("i", F.explode(F.filter(found, lambda x: x.isNotNull())))
    pages = F.when(F.col("i.issue_type") == "multi_column_reading_order_review", F.array_join("multi_column_pages", ", "))
    return rows.select("doc_id", "i.*", pages.alias("pages"))
