"""Rebuilt documents read again, on hand-made elements."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairn.operators import rebuild, reports, roundtrip

ELEMENT = """doc_id long, pos long, type string, text string, heading_level long, confidence double, alt_text string, table_headers array<string>, list_label string,
    decorative boolean, n_headers long, page_number long, element_id string, href string, x0 double, y0 double, x1 double, y1 double, k long"""


def element(pos, kind, text="", doc=1, level=None, alt=None, headers=(), href=None, conf=0.9):
    return (doc, pos, kind, text, level, conf, alt, list(headers), None, False, len(headers), 1, str(pos), href, 72.0, 100.0 * pos, 200.0, 100.0 * pos + 20, 1)


def again(spark, rows, values=(), alts=()):
    elements = spark.createDataFrame(rows, ELEMENT)
    docs = spark.createDataFrame([(d, None, None) for d in sorted({r[0] for r in rows} | {9})], "doc_id long, title string, language string")
    made = spark.createDataFrame(list(values), "doc_id long, action string, value string")
    told = spark.createDataFrame(list(alts), "doc_id long, pos long, alt string")
    docs, plan = roundtrip.rebuilt(docs, elements, made, told)
    return docs, plan


def test_elements_come_back(spark):
    rows = [element(0, "heading", "Report", level=1), element(1, "paragraph", "Body text"), element(2, "list_item", "One"), element(3, "table", "a,b", headers=["h", "i"]), element(4, "image"), element(5, "paragraph", "more"), element(6, "link", "Our site", href="https://x.org"), element(7, "link", "No address")]
    docs, plan = again(spark, rows, [(1, "set_document_title", "Mine")], [(1, 4, "A chart")])
    got = [(r["type"], r["text"], r["heading_level"]) for r in roundtrip.read_again(plan).orderBy("pos").collect()]
    assert got == [("heading", "Report", 2), ("paragraph", "Body text", None), ("paragraph", "- One", None), ("paragraph", "h", None), ("paragraph", "i", None), ("paragraph", "a", None), ("paragraph", "b", None), ("paragraph", "Figure: A chart", None), ("paragraph", "more", None), ("paragraph", "Our site", None), ("paragraph", "No address", None), ("link", "Our site No address", None)]
    assert sorted(tuple(r) for r in docs.collect()) == [(1, "Mine", "en-AU"), (9, "Accessible Document", "en-AU")]
    assert [(r["page_count"], r["text_block_count"], r["multi_column_pages"]) for r in roundtrip.inspect_again(docs, plan).orderBy("doc_id").collect()] == [(1, 11, [1]), (1, 0, [])]


def test_wide_tables_are_columns(spark):
    _, plan = again(spark, [element(0, "table", "a,b,c\nd,e,f\ng,h,i")])
    assert roundtrip.inspect_again(spark.createDataFrame([(1, "T", "en")], "doc_id long, title string, language string"), plan).first()["multi_column_pages"] == [1]


def test_long_texts_take_lines_and_pages(spark):
    long = "word " * 3000
    _, plan = again(spark, [element(0, "paragraph", long), element(1, "paragraph", "next")])
    rows = {r["pos"]: (r["page_index"], r["block_count"], r["y"]) for r in plan.collect()}
    assert rows == {0: (0, 215, 72.0), 1: (1, 1, 72.0)}


def test_before_and_after(spark):
    rows = [element(0, "paragraph", "p"), element(1, "image"), element(2, "link", "click here", href="https://x.org"), element(3, "table", "a,b")]
    elements = spark.createDataFrame(rows, ELEMENT)
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, title string, language string")
    scan = docs.select("doc_id", F.lit(False).alias("is_encrypted"), F.lit(False).alias("has_struct_tree"), F.lit(False).alias("mark_info_marked"), F.lit(1).alias("page_count"), F.lit(3).alias("text_block_count"), F.array().cast("array<long>").alias("multi_column_pages"), F.lit(None).cast("string").alias("language"))
    source = roundtrip.all_issues(docs, scan, elements).withColumn("final_status", F.when(F.col("issue_type") == "missing_table_headers", "rejected").otherwise("accepted"))
    named, plan = roundtrip.rebuilt(docs, elements, spark.createDataFrame([], "doc_id long, action string, value string"), spark.createDataFrame([(1, 1, "A chart")], "doc_id long, pos long, alt string"))
    got = {(r["bucket"], r["issue_type"]): r["n"] for r in roundtrip.compared(source, named, plan).collect()}
    assert got == {
        ("fixed", "untagged_pdf"): 1, ("fixed", "missing_document_title"): 1, ("fixed", "missing_document_language"): 1, ("fixed", "missing_image_alt_text"): 1, ("rejected", "missing_table_headers"): 1,
        ("remaining", "weak_link_text"): 1, ("manual", "weak_link_text"): 1, ("remaining", "missing_heading_structure"): 1, ("manual", "missing_heading_structure"): 1,
    }


@pytest.mark.parametrize(("statuses", "after", "want"), [(["accepted", "rejected"], [], {"fixed": 1, "rejected": 1}), (["accepted"], ["auto_fixable"], {"remaining": 1}), (["rejected"], ["cannot_automate"] * 2, {"rejected": 1, "remaining": 2, "manual": 2}), ([], ["auto_fixable"], {"remaining": 1}), (["open"], [], {"fixed": 1})])
def test_buckets(spark, statuses, after, want):
    source = spark.createDataFrame([(1, "t", x) for x in statuses], "doc_id long, issue_type string, final_status string")
    later = spark.createDataFrame([(1, "t", x) for x in after], "doc_id long, issue_type string, automation_status string")
    assert {r["bucket"]: r["n"] for r in reports.before_after(source, later).collect()} == want


def test_reading_again_numbers_rows_once(spark):
    """Lines are dealt by document once and numbered once; what links meet is read, not made again."""
    plan = spark.createDataFrame([(1, 1, "Link", 0, 72.0, 1, [("a", 72.0, 72.0, 11.0)], "https://a"), (1, 0, "P", 0, 96.0, 1, [("b", 72.0, 96.0, 11.0)], None)], f"doc_id long, pos long, role string, page_index long, y double, block_count long, lines {'array<' + rebuild.LINE + '>'}, href string")
    again = roundtrip.read_again(plan)
    assert [(r["pos"], r["type"], r["text"], r["element_id"]) for r in again.orderBy("pos").collect()] == [(0, "paragraph", "a", "1:1"), (1, "paragraph", "b", "1:2"), (2, "link", "a b", "1:link:1")]
    assert "Window" not in again._jdf.queryExecution().optimizedPlan().toString()


def test_alt_texts_meet_in_one_join(spark):
    """Ids, boxes, pages and places are keys of one join with accepted texts, however many ways there are."""
    place = "element_id string, page_number long, x0 double, y0 double, x1 double, y1 double"
    box, none = (1.0, 2.0, 3.0, 4.0), (None,) * 4
    images = spark.createDataFrame([(1, 0, "image", None, False, "a", 1, *box), (1, 1, "image", " own ", False, "b", 2, *box), (1, 2, "image", None, False, None, None, 1.0, None, 3.0, 4.0), (1, 3, "image", None, False, "", 3, *none), (1, 4, "image", None, True, "a", 9, *box), (2, 0, "image", None, False, "a", 1, *box)], f"doc_id long, pos long, type string, alt_text string, decorative boolean, {place}")
    accepted = spark.createDataFrame([(1, 0, "A", "a", 7, *box), (1, 1, "B", "", 2, *box), (1, 2, "C", None, 0, 1.0, None, 3.0, 4.0), (1, 3, "D", None, None, 1.0, None, 3.0, 4.0), (1, 4, "E", "", 3, *none), (1, 5, " ", "a", 1, *box), (1, 6, "F", "z", 1, *none)], f"doc_id long, seq long, value string, {place}")
    got = rebuild.alt_texts(images, accepted)
    assert [tuple(r) for r in got.orderBy("doc_id", "pos").collect()] == [(1, 0, "F"), (1, 1, "B"), (1, 2, "D"), (1, 3, "E"), (1, 4, ""), (2, 0, None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
