"""Inspections from catalogs and pages that are partly broken, and rules of a user's own."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cairn.operators import inspection, rules

from .test_roundtrip import ELEMENT, element

CATALOG, PAGE = "doc_id long, is_encrypted boolean, title string, catalog string", "doc_id long, page_index long, blocks string, images string, links string, content string"
NODE = {"Type": "/StructElem", "S": "/L", "K": [{"Type": "/StructElem", "S": "/LI", "K": {"Type": "/StructElem", "S": "/LBody", "K": 3}}]}


def inspected(spark, catalogs, pages=()):
    rows = inspection.inspections(spark.createDataFrame(catalogs, CATALOG), spark.createDataFrame(list(pages), PAGE)).collect()
    return {r["doc_id"]: r for r in rows}


def test_catalogs(spark):
    whole = json.dumps({"Lang": " en ", "MarkInfo": {"Marked": True}, "StructTreeRoot": {"K": NODE, "ParentTree": {"Nums": [0, [1, 2, 3], 1, None, 2, "x"]}}})
    got = inspected(spark, [(1, False, " T ", whole), (2, True, "T", whole), (3, None, " ", "{}"), (4, False, None, None), (5, False, None, "{broken"), (6, False, None, "[1]"), (7, False, None, '{"StructTreeRoot": null, "MarkInfo": {"Marked": "yes"}}')])
    of = lambda d: [got[d][c] for c in ("has_struct_tree", "mark_info_marked", "language", "title", "structure_element_count", "parent_tree_entry_count")]
    assert of(1) == [True, True, "en", "T", 3, 4] and got[1]["extraction_warnings"] == []
    assert of(2) == [None, None, None, "T", 0, 0] and got[2]["extraction_warnings"] == [inspection.ENCRYPTED]
    assert of(3) == [False, False, None, None, 0, 0]
    assert {tuple(of(d)) for d in (4, 5, 6)} == {(None, None, None, None, 0, 0)} and {tuple(got[d]["extraction_warnings"]) for d in (4, 5, 6)} == {("The catalog cannot be read.",)}
    assert of(7) == [False, True, None, None, 0, 0]


def test_broken_pages_are_warnings(spark):
    pages = [(1, 0, '["a", " ", "b"]', "[1, 2]", "[]", "/MCID 0 /MCID 1"), (1, 1, "[", "[1]", None, None), (1, 2, '{"a": 1}', "", '["x"]', "q"), (2, 0, "[]", "[]", "[]", "/MCID")]
    got = inspected(spark, [(1, False, None, "{}"), (2, True, None, "{}"), (3, False, None, "{}")], pages)
    assert [got[1][c] for c in ("page_count", "text_block_count", "image_count", "link_count", "marked_content_count")] == [3, 2, 3, 1, 2]
    assert got[1]["extraction_warnings"] == ["The text of page 2 cannot be read.", "The links of page 2 cannot be read.", "The text of page 3 cannot be read.", "The images of page 3 cannot be read."]
    assert [got[2][c] for c in ("page_count", "text_block_count", "marked_content_count")] == [1, 0, 0]
    assert [got[3][c] for c in ("page_count", "text_block_count")] == [0, 0]


def test_from_pages_to_issues(spark):
    rows = inspection.inspections(spark.createDataFrame([(1, True, None, None), (2, False, None, "{}"), (3, False, None, None)], CATALOG), spark.createDataFrame([(2, 0, "[]", "[]", "[]", None), (3, 0, '["x"]', "[]", "[]", None)], PAGE))
    found = rules.inspection_issues(rows.withColumn("multi_column_pages", F.array(F.lit(1)).cast("array<long>")))
    got: dict[int, set] = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add(r["issue_type"])
    assert got == {1: {"encrypted_pdf", "missing_document_language"}, 2: {"untagged_pdf", "no_extractable_pdf_text", "multi_column_reading_order_review", "missing_document_language"}, 3: {"unknown_pdf_tagging", "multi_column_reading_order_review", "missing_document_language"}}


def test_own_rules_cost_no_scan(spark, tmp_path):
    spark.createDataFrame([element(0, "heading", "Report", level=1), element(1, "image"), element(2, "paragraph", "x" * 50)], ELEMENT).write.parquet(str(tmp_path / "e"))
    elements = spark.read.parquet(str(tmp_path / "e"))
    more = [rules.Rule("own.1", "long_text", "length(text) > 40", "low", 0.5, rules.AUTO, "'Cut it.'"), rules.Rule("own.2", "any", F.col("type") == "image", confidence=F.lit(1.0))]
    plans = [rules.element_issues(elements, m)._jdf.queryExecution().executedPlan().toString() for m in ((), more)]
    assert all(plans[0].count(x) == plans[1].count(x) > 0 for x in ("FileScan", "Exchange", "Window"))
    got = [(r["issue_ord"], r["pos"], r["rule_id"], r["confidence"], r["automation_status"], r["suggested_fix"]) for r in rules.element_issues(elements, more).orderBy("issue_ord").collect()]
    assert got == [(0, 1, "wcag.images.alt_text", 0.9, rules.CONFIRM, None), (1, 1, "own.2", 1.0, rules.CONFIRM, None), (2, 2, "own.1", 0.5, rules.AUTO, "Cut it.")]
    with pytest.raises(ValueError, match="two rules"):
        rules.element_issues(elements, [more[0], more[0]])
    with pytest.raises(Exception, match="no_such"):
        rules.element_issues(elements, [rules.Rule("own.3", "t", "no_such > 1")]).collect()
