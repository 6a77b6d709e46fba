"""From plan to document and back: what a rebuilt document holds, read again as any other document, and both analyses compared.

The rebuilt document is known by where its lines stand (the plan's layout), so
it is read from those: lines of text, link areas and pages, through the same
layout rules as scanned ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import layout, rebuild, reports, rules, service
from cairn.operators.rebuild import BOX, LEFT, WIDTH
from cairn.sources.shared import WITHIN, written

#: What a line of text takes, of its size: above and below its baseline, and to the right for each character.
ABOVE, BELOW, EACH = 1.0, 0.25, 0.5


def generated_lines(plan: DataFrame) -> DataFrame:
    """(doc_id, page_number, text, font_size, x0, y0, x1, y1) of the rebuilt documents' lines that are not empty."""
    rows = plan.select("doc_id", (F.col("page_index") + 1).alias("page_number"), F.explode("lines").alias("l")).filter("l.text <> ''")
    x, y, size = F.col("l.x"), F.col("l.y"), F.col("l.size")
    return rows.select("doc_id", "page_number", "l.text", size.alias("font_size"), x.alias("x0"), (y - size * ABOVE).alias("y0"), (x + size * EACH * F.length("l.text")).alias("x1"), (y + size * BELOW).alias("y1"))


def generated_links(plan: DataFrame) -> DataFrame:
    """(doc_id, page_number, pos, href, x0, y0, x1, y1) of the rebuilt documents' links: an area of a line's height below the last baseline."""
    below = F.col("y") + 16 * F.col("block_count")
    rows = plan.filter("role = 'Link' and coalesce(href, '') <> ''")
    return rows.select("doc_id", (F.col("page_index") + 1).alias("page_number"), "pos", "href", F.lit(LEFT).alias("x0"), (below - 16).alias("y0"), F.lit(LEFT + WIDTH).alias("x1"), below.alias("y1"))


def _read_rows(plan: DataFrame) -> DataFrame:
    """What read_again finds before links have their texts: (doc_id, page_number, part, nth, pos, type, text, heading_level, href, x0..y1, font_size).

    Lines are part 0 and links part 1. They come from one exchange by document
    and one sort, which the places on the page and in the document share.
    """
    x, y, size = F.col("l.x"), F.col("l.y"), F.col("l.size")
    none = F.lit(None)
    line = lambda l: F.struct(F.lit(0).alias("part"), l["text"].alias("text"), l["x"].alias("x"), l["y"].alias("y"), l["size"].alias("size"))
    link = F.struct(F.lit(1).alias("part"), F.lit("").alias("text"), F.lit(LEFT).alias("x"), (F.col("y") + 16 * F.col("block_count")).alias("y"), none.cast("double").alias("size"))
    is_link = F.coalesce((F.col("role") == "Link") & (F.coalesce("href", F.lit("")) != ""), F.lit(False))
    shown = F.transform(F.filter(F.coalesce("lines", F.array().cast(f"array<{rebuild.LINE}>")), lambda l: l["text"] != ""), line)
    dealt = plan.select("doc_id", "page_index", "pos", F.when(is_link, F.col("href")).alias("href"), F.when(is_link, F.concat(shown, F.array(link))).otherwise(shown).alias("found")).repartition("doc_id")
    rows = dealt.select("doc_id", (F.col("page_index") + 1).alias("page_number"), F.col("pos").alias("at"), "href", F.explode("found").alias("l"))
    text = F.col("l.part") == 0
    rows = rows.select(
        "doc_id", "page_number", F.col("l.part").alias("part"), F.when(~text, F.col("at")).alias("at"), "l.text", F.when(~text, F.col("href")).alias("href"), size.alias("font_size"),
        x.alias("x0"), F.when(text, y - size * ABOVE).otherwise(y - 16).alias("y0"), F.when(text, x + size * EACH * F.length("l.text")).otherwise(LEFT + WIDTH).alias("x1"), F.when(text, y + size * BELOW).otherwise(y).alias("y1"),
    )
    place = ["at", *[F.when(F.col("part") == 0, F.col(c)) for c in ("y0", "x0", "text")]]
    rows = rows.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "part", *place)) - 1).cast("long"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "page_number", "part").orderBy(*place)).cast("long"))
    body = F.coalesce(F.median(F.when(F.col("font_size") != 0, F.col("font_size"))).over(Window.partitionBy("doc_id", "page_number")), F.lit(0.0))
    rows = rows.withColumn("body", body)
    heads = layout.heading(F.col("text"), F.col("font_size"), F.col("body"))
    kind = F.when(F.col("part") == 1, "link").when(heads, "heading").otherwise("paragraph")
    level = F.when((F.col("part") == 0) & heads, layout.heading_level(F.col("font_size"), F.col("body"))).cast("long")
    return rows.select("doc_id", "page_number", "part", "nth", "pos", kind.alias("type"), "text", level.alias("heading_level"), "href", *BOX, "font_size")


def read_again(plan: DataFrame) -> DataFrame:
    """The elements of rebuilt documents: on each page its lines from top to bottom, left to right, then its links.

    (doc_id, pos, type, text, heading_level, confidence, href, page_number,
    element_id, x0..y1, font_size) and alt_text, decorative and n_headers, which
    none has. Frames of images are drawings, so no image is found again; cells of
    tables are lines. All rows are numbered in one pass and written; only links meet the lines again.
    """
    rows = written(_read_rows(plan), "read_rows")
    name = F.concat(F.col("page_number").cast("string"), F.when(F.col("part") == 1, F.lit(":link:")).otherwise(F.lit(":")), F.col("nth").cast("string"))
    named = layout.link_rows(rows).select("doc_id", "pos", F.col("text").alias("shown"), F.col("confidence").alias("trust"))
    links = rows.filter("part = 1").join(named, ["doc_id", "pos"], "left")
    found = rows.filter("part = 0").unionByName(links, allowMissingColumns=True)
    return found.select("doc_id", "pos", "type", F.coalesce("shown", "text").alias("text"), "heading_level", F.coalesce("trust", layout.block_confidence(F.lit(1))).alias("confidence"), "href", "page_number", name.alias("element_id"), *BOX, "font_size", F.lit(None).cast("string").alias("alt_text"), F.lit(False).alias("decorative"), F.lit(0).cast("long").alias("n_headers"))


def inspect_again(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """Inspections of rebuilt documents (doc_id, title, language): tagged, open, with their pages, lines and pages in columns.

    A document without content has one empty page.
    """
    lines = generated_lines(plan)
    columns = layout.multi_column(lines, ["doc_id", "page_number"]).groupBy("doc_id").agg(F.sum("lines").alias("blocks"), F.sort_array(F.collect_list(F.when(F.col("multi_column"), F.col("page_number")))).alias("multi_column_pages"))
    pages = plan.groupBy("doc_id").agg((F.max("page_index") + 1).alias("pages"))
    rows = documents.select("doc_id", "title", "language").join(pages, "doc_id", "left").join(columns, "doc_id", "left")
    return rows.select("doc_id", "title", "language", F.lit(False).alias("is_encrypted"), F.lit(True).alias("has_struct_tree"), F.lit(True).alias("mark_info_marked"), F.coalesce("pages", F.lit(1)).cast("long").alias("page_count"), F.coalesce("blocks", F.lit(0)).cast("long").alias("text_block_count"), F.coalesce("multi_column_pages", F.array().cast("array<long>")).alias("multi_column_pages"))


def all_issues(documents: DataFrame, inspections: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, part, at, issue_type, severity, automation_status) of whole analyses: inspections, then documents, then elements."""
    cols = ["issue_type", "severity", "automation_status"]
    pdf = rules.inspection_issues(inspections).filter("issue_type <> 'missing_document_language'").select("doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), *cols)
    whole = service.document_issues(documents, elements).select("doc_id", F.lit(1).alias("part"), F.col("rank").cast("long").alias("at"), *cols)
    single = rules.element_issues(elements).select("doc_id", F.lit(2).alias("part"), F.col("issue_ord").alias("at"), *cols)
    return pdf.unionByName(whole).unionByName(single)


def renamed(documents: DataFrame, elements: DataFrame, values: DataFrame) -> DataFrame:
    """documents after remediation: accepted titles and languages (doc_id, action, value) put in. Takes no plan."""
    return rebuild.document_values(documents, values, rules.first_text(elements))


def rebuilt(documents: DataFrame, elements: DataFrame, values: DataFrame, alts: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, plan) after remediation: accepted titles and languages (doc_id, action, value) and alternative texts (doc_id, pos, alt) put in.

    The plan is written, as lines, links and pages are all read from it. Elements
    that are dealt by document (into `parts`) stay where they are for all its joins.
    """
    return renamed(documents, elements, values), written(rebuild.structure_plan(elements, alts, parts), "plan", WITHIN)


def compared(source_issues: DataFrame, documents: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, bucket, issue_type, n): issues of the source (with final_status) against those of the rebuilt documents."""
    again = all_issues(documents, inspect_again(documents, plan), written(read_again(plan), "read_again"))
    return reports.before_after(source_issues, again)
