"""Whole reports and the sink that writes them as files."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from cairn.operators import analysis
from cairn.sources import report_files

from .test_roundtrip import ELEMENT, element


@pytest.fixture(scope="module")
def parts(spark):
    rows = [element(0, "heading", "Report", level=1), element(1, "heading", "Low", level=3), element(2, "image"), element(3, "paragraph", "p", conf=0.5)]
    elements = spark.createDataFrame(rows, ELEMENT).withColumn("nearby_text", F.lit(""))
    docs = spark.createDataFrame([(1, None, "en"), (2, "T", " ")], "doc_id long, title string, language string")
    scan = docs.select("doc_id", F.lit(False).alias("is_encrypted"), F.lit(True).alias("has_struct_tree"), F.lit(None).cast("boolean").alias("mark_info_marked"), F.lit(1).alias("page_count"), F.lit(3).alias("text_block_count"), F.array(F.lit(2)).cast("array<long>").alias("multi_column_pages"), "language")
    found = analysis.issues(docs, scan, elements)
    made = analysis.suggested(found, elements, docs.select("doc_id", F.lit("de").alias("metadata_language")))
    return docs.select("doc_id", F.concat(F.lit("f"), "doc_id", F.lit(".pdf")).alias("file"), F.lit("pdf").alias("format")), scan, found, made


def report_of(parts, jobs=None):
    docs, scan, found, made = parts
    rows = analysis.whole_reports(docs, scan, found, made, F.lit("now"), jobs)
    return {r["doc_id"]: json.loads(r["t"]) for r in rows.select("doc_id", F.to_json("report").alias("t")).collect()}


def test_every_part(spark, parts):
    got = report_of(parts)[1]
    assert list(got) == sorted(["file", "target", "generated_at", "source", "summary", "issues", "suggestions", "audit_events"])
    kinds = ["multi_column_reading_order_review", "untagged_pdf", "missing_document_title", "skipped_heading_level", "missing_image_alt_text", "low_reading_order_confidence"]
    assert [i["issue_type"] for i in got["issues"]] == kinds
    assert [i["issue_ord"] for i in got["issues"]] == [s["issue_ord"] for s in got["suggestions"]] == [e["issue_ord"] for e in got["audit_events"]] == list(range(6))
    title = got["issues"][2]
    assert (title["rule_id"], title["confidence"], title["suggested_fix"], title["automation_status"], title["final_status"]) == ("wcag.document.title", 0.85, "Report", "auto_fixable", "open")
    assert got["issues"][0]["source"]["description"] == "2" and got["issues"][4]["source"]["bbox"] == [72, 200, 200, 220]
    assert [s["action"] for s in got["suggestions"]] == ["confirm_reading_order", "rebuild_pdf_tags", "set_document_title", "adjust_heading_level", "generate_alt_text", "confirm_reading_order"]
    assert got["summary"]["severity_counts"] == {"critical": 1, "high": 3, "medium": 2} and got["summary"]["initial_issue_count"] == got["summary"]["suggestion_count"] == 6
    assert got["source"]["pdf"]["page_count"] == 1 and got["file"] == "f1.pdf" and got["target"] == "WCAG 2.2 AA"
    assert got["audit_events"][1]["metadata"] == {"action": "rebuild_pdf_tags", "source": "rule", "requires_user_confirmation": False}


def test_documents_without_elements_and_jobs(spark, parts):
    kind = "doc_id long, job_id long, status string, created_at string, updated_at string, artifacts array<struct<id:string,type:string>>"
    got = report_of(parts, spark.createDataFrame([(2, 20, "reviewed", "a", "b", [("x", "accessible_pdf")])], kind))
    assert set(got) == {2} and len(got[2]) == 10
    assert got[2]["job"] == {"id": 20, "status": "reviewed", "created_at": "a", "updated_at": "b"} and got[2]["output_artifacts"] == [{"id": "x", "type": "accessible_pdf"}]
    assert [i["issue_type"] for i in got[2]["issues"]] == ["multi_column_reading_order_review", "untagged_pdf", "missing_document_language"]
    language = got[2]["suggestions"][2]
    assert (language["action"], language["proposed_value"]) == ("set_document_language", "de")


def test_a_report_read_back(spark, parts):
    docs, scan, found, made = parts
    none = analysis.whole_reports(docs, scan, found.limit(0), made.limit(0), F.lit("now"))
    assert [tuple(r) for r in none.orderBy("doc_id").select(F.variant_get("report", "$.summary.initial_issue_count", "int"), F.to_json(F.variant_get("report", "$.issues", "variant")), F.to_json(F.variant_get("report", "$.summary.severity_counts", "variant"))).collect()] == [(0, "[]", "{}")] * 2
    assert analysis.listed(none, "issues", {"severity": "string"}).count() == 0


def test_within_documents_as_by_tables(spark):
    """Ids, boxes and whole sources that several elements have, blank ids, elements without a place, an element with two issues, documents without elements or inspection."""
    rows = [element(k, kind, "click here" if kind == "link" else f"t{k}", level=1 + 2 * (k % 2), conf=0.5 if k % 3 else 0.9) for k, kind in enumerate(["heading", "heading", "image", "image", "link", "link", "table", "paragraph"])]
    rows = spark.createDataFrame(rows, ELEMENT).withColumn("nearby_text", F.when(F.col("pos") % 4 == 0, " near ")).withColumn("element_id", F.when(F.col("pos") < 4, "e").when(F.col("pos") == 5, " "))
    rows = rows.withColumn("y0", F.when(F.col("pos") > 2, F.floor(F.col("pos") / 2).cast("double"))).withColumn("y1", F.when(F.col("pos") > 2, F.lit(9.0))).withColumn("page_number", F.when(F.col("pos") < 7, F.col("page_number")))
    flat = rows.filter("type = 'paragraph'").withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("doc_id", F.lit(2).cast("long"))
    elements = rows.unionByName(flat)
    docs = spark.createDataFrame([(1, None, "en", 2), (2, "T", " ", 0), (3, None, None, 1), (4, "T", "en", 0)], "doc_id long, title string, language string, page_count long")
    scan = docs.filter("doc_id <> 4").select("doc_id", (F.col("doc_id") == 3).alias("is_encrypted"), F.lit(None).cast("boolean").alias("has_struct_tree"), F.lit(None).cast("boolean").alias("mark_info_marked"), "page_count", F.lit(0).cast("long").alias("text_block_count"), F.array(F.lit(2), F.lit(5)).cast("array<long>").alias("multi_column_pages"), "language")
    found = analysis.issues(docs, scan, elements)
    made = analysis.suggested(found, elements, docs.select("doc_id", F.lit("de").alias("metadata_language")))
    files = docs.select("doc_id", F.concat(F.lit("f"), "doc_id").alias("file"), F.lit("pdf").alias("format"))
    want = analysis.whole_reports(files, scan, found, made, F.lit("now"))
    one = files.join(docs.select("doc_id", "title", "language", F.lit("de").alias("metadata_language")), "doc_id").join(scan.select("doc_id", F.struct(*scan.columns[1:]).alias("pdf")), "doc_id", "left")
    got = analysis.reports_within(one, elements, F.lit("now"))
    read = lambda df: {r["doc_id"]: json.loads(r["t"]) for r in df.select("doc_id", F.to_json("report").alias("t")).collect()}
    assert read(got) == read(want) and len(read(got)[1]["issues"]) > 8


@pytest.fixture
def sink(spark):
    spark.dataSource.register(report_files.ReportFiles)
    return lambda rows, path, mode="append": (spark.createDataFrame(rows, "name string, text string").repartition(3) if isinstance(rows, list) else rows).write.format("report_files").mode(mode).save(str(path))


def test_files_by_name(sink, tmp_path):
    sink([("a.json", "{}"), ("b.json", "é"), ("c.json", None)], tmp_path / "out")
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.json": "{}", "b.json": "é", "c.json": ""}
    with pytest.raises(Exception, match="there already"):
        sink([("d.json", "x"), ("a.json", "y")], tmp_path / "out")
    assert sorted(os.listdir(tmp_path / "out")) == ["a.json", "b.json", "c.json"] and (tmp_path / "out/a.json").read_text() == "{}"
    sink([("a.json", "new")], tmp_path / "out", "overwrite")
    assert (tmp_path / "out/a.json").read_text() == "new" and len(os.listdir(tmp_path / "out")) == 3
    sink([], tmp_path / "out")


@pytest.mark.parametrize("rows", [[("a", "1"), ("a", "2")], [("a", "1"), ("x/y", "2")], [("a", "1"), (None, "2")], [("a", "1"), (".b", "2")]])
def test_bad_names_leave_nothing(sink, tmp_path, rows):
    with pytest.raises(Exception, match="name"):
        sink(rows, tmp_path / "out")
    assert [n for n in os.listdir(tmp_path / "out") if not n.startswith(".")] == []


def test_a_failed_task_leaves_no_file(spark, sink, tmp_path):
    bad = spark.range(40).repartition(4).select(F.concat("id", F.lit(".json")).alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken row"))).otherwise(F.lit("x")).alias("text"))
    with pytest.raises(Exception, match="broken row"):
        sink(bad, tmp_path / "out")
    assert not (tmp_path / "out").exists() or [n for n in os.listdir(tmp_path / "out") if not n.startswith(".")] == []


def test_many_files_lie_in_folders(spark, sink, tmp_path):
    """The driver is told of folders, not of files; names are those of the rows."""
    rows = spark.range(500).select(F.concat("id", F.lit(".json")).alias("name"), F.col("id").cast("string").alias("text"))
    report_files.write_in_folders(rows, str(tmp_path / "out"), 3)
    assert len(os.listdir(tmp_path / "out")) == 3 and all(p.is_dir() for p in (tmp_path / "out").iterdir())
    found = spark.read.format("report_files").load(str(tmp_path / "out"))
    assert {tuple(r) for r in found.collect()} == {(f"{k}.json", str(k)) for k in range(500)} and found.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="there already"):
        report_files.write_in_folders(rows, str(tmp_path / "out"), 3)
    with pytest.raises(Exception, match="name"):
        report_files.write_in_folders(rows.unionByName(rows), str(tmp_path / "two"), 3)
    assert len(os.listdir(tmp_path / "out")) == 3 and [n for n in os.listdir(tmp_path / "two") if not n.startswith(".")] == []
    written = report_files.FolderWriter(str(tmp_path / "three"), False).write(iter([{"name": "a", "text": "x"}]))
    assert written.names == []


def test_files_in_the_target_are_read(spark, sink, tmp_path):
    sink([("a.json", "{}"), ("b.json", "\u00e9")], tmp_path / "out")
    assert {tuple(r) for r in spark.read.format("report_files").load(str(tmp_path / "out")).collect()} == {("a.json", "{}"), ("b.json", "\u00e9")}


def test_many_files_lie_in_packages(spark, sink, tmp_path):
    """A package for each partition, smaller than its texts, from which any tar takes named files."""
    rows = spark.range(500).select(F.concat("id", F.lit(".json")).alias("name"), F.when(F.col("id") != 7, F.concat(F.lit("\u00e9" * 300), F.col("id").cast("string"))).alias("text")).repartition(3)
    report_files.write_in_packages(rows, str(tmp_path / "out"), rows.select("name"))
    found = spark.read.format("report_files").option("packages", "true").load(str(tmp_path / "out"))
    assert {tuple(r) for r in found.collect()} == {(r["name"], r["text"] or "") for r in rows.collect()} and found.rdd.getNumPartitions() == 3
    packed = [f for _, _, names in os.walk(tmp_path / "out") for f in names if not f.startswith(".")]
    assert packed == [report_files.PACKAGE] * 3 and sum(p.stat().st_size for p in (tmp_path / "out").rglob("*.zst")) < 50_000
    with pytest.raises(Exception, match="there already"):
        report_files.write_in_packages(rows, str(tmp_path / "out"), rows.select("name"))
    for twice in (rows.unionByName(rows), rows.withColumn("name", F.lit("a/b"))):
        with pytest.raises(Exception, match="name"):
            report_files.write_in_packages(twice, str(tmp_path / "two"), twice.select("name"))
    assert not (tmp_path / "two").exists()
    with pytest.raises(Exception, match="no name"):
        report_files.write_in_packages(rows.withColumn("name", F.concat(F.lit("/"), "name")), str(tmp_path / "two"), rows.select("name"))
    assert [n for n in os.listdir(tmp_path / "two") if not n.startswith(".")] == []
    large = spark.range(4).select(F.concat("id", F.lit(".json")).alias("name"), F.repeat(F.col("id").cast("string"), 3_000_000).alias("text")).coalesce(1)  # several frames
    report_files.write_in_packages(large, str(tmp_path / "large"), large.select("name"))
    assert {tuple(r) for r in spark.read.format("report_files").option("packages", "true").load(str(tmp_path / "large")).collect()} == {tuple(r) for r in large.collect()}
    none = rows.limit(0)
    report_files.write_in_packages(none, str(tmp_path / "none"), none.select("name"))
    assert spark.read.format("report_files").option("packages", "true").load(str(tmp_path / "none")).count() == 0
