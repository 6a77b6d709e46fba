"""Structural checks on hand-made trees: every document has a row for every check."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairn.operators import tagtree, validation

PLAN = "doc_id long, pos long, role string, page_index long, row_sizes array<int>, n_headers long, alt_text string, decorative boolean, k long"
ROWS = [(0, "H1", 0, [], 0), (1, "Table", 0, [2, 2], 1), (2, "LI", 0, [], 0), (3, "LI", 0, [], 0), (4, "Figure", 1, [], 0), (5, "Link", 1, [], 0), (6, "Link", 1, [], 0), (7, "P", 1, [], 0)]


def plan_of(spark, rows=ROWS, doc=1, k=1, alt="a"):
    return spark.createDataFrame([(doc, p, r, page, sizes, n, alt, False, k) for p, r, page, sizes, n in rows], PLAN)


def failed(spark, found, planned=True, doc=1, flags=(True, True)):
    docs = spark.createDataFrame([(doc, *flags)], "doc_id long, has_struct_tree boolean, mark_info_marked boolean")
    rows = validation.check_rows(validation.validate(docs, found, planned)).collect()
    assert [r["check_id"] for r in rows] == validation.CHECKS[: 10 if planned else 9]
    return {r["check_id"].removeprefix("structure."): r["failures"] for r in rows if not r["passed"]}


def tables(spark, hurt=lambda t: t, **more):
    """A plan's records, of which hurt changes the tree alone."""
    plan = plan_of(spark, **more)
    tree = tagtree.nodes(tagtree.with_struct_parents(plan))
    parents = tagtree.parent_tree(tree).withColumnRenamed("key", "page_index").withColumnRenamed("entries", "n")
    marks = tree.filter("is_leaf").groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("n"))
    return plan, hurt(tree), parents, marks


def test_a_whole_tree_passes(spark):
    assert failed(spark, validation.records(*tables(spark))) == {}
    assert failed(spark, tagtree.tagged_records(plan_of(spark))) == {}


def test_both_ways_to_records_agree(spark):
    plan = plan_of(spark).unionByName(plan_of(spark, doc=2, k=11)).unionByName(plan_of(spark, doc=3, k=19))
    tree = tagtree.nodes(tagtree.with_struct_parents(plan))
    parents = tagtree.parent_tree(tree).withColumnRenamed("key", "page_index").withColumnRenamed("entries", "n")
    marks = tree.filter("is_leaf").groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("n"))
    one, two = (validation.evaluated(x) for x in (validation.records(plan, tree, parents, marks), tagtree.tagged_records(plan)))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(*one.columns).collect()))


@pytest.mark.parametrize(("hurt", "checks"), [
    ("role <> 'LBody' or pos <> 2", {"lists_have_roles": 1, "reading_order_matches_plan": None}),
    ("role not in ('LI', 'Lbl', 'LBody')", {"lists_have_roles": 1, "matches_plan": None, "reading_order_matches_plan": None}),
    ("role <> 'TH'", {"tables_have_roles": 1, "reading_order_matches_plan": None}),
    ("role <> 'TR'", {"tables_have_roles": 1}),
    ("role not in ('TH', 'TD') or row = 0", {"tables_have_roles": 1, "reading_order_matches_plan": None}),
    ("pos <> 7", {"matches_plan": None, "reading_order_matches_plan": None}),
])
def test_lost_nodes(spark, hurt, checks):
    got = failed(spark, validation.records(*tables(spark, lambda t: t.filter(hurt))))
    assert set(got) == set(checks)
    assert all(n is None or got[c] == n for c, n in checks.items())


@pytest.mark.parametrize(("change", "value", "checks"), [
    ("alt", "case when role <> 'Figure' then alt end", {"figures_have_alt"}), ("struct_parent", "case when pos <> 5 then struct_parent end", {"links_reference_annotations"}),
    ("struct_parent", "case when pos = 5 then 99 else struct_parent end", {"link_annotations_mapped"}), ("mcid", "9 - mcid", {"reading_order_matches_plan"}),
    ("mcid", "case when pos <> 0 then mcid end", {"reading_order_matches_plan"}), ("role", "case when pos = 0 then 'H2' else role end", {"reading_order_matches_plan", "matches_plan"}),
    ("role", "case when role = 'TD' then 'P' else role end", {"tables_have_roles", "reading_order_matches_plan"}),
])
def test_changed_nodes(spark, change, value, checks):
    assert set(failed(spark, validation.records(*tables(spark, lambda t: t.withColumn(change, F.expr(value)))))) == checks


def test_parent_tree_short_or_lacking(spark):
    plan, tree, parents, marks = tables(spark)
    assert set(failed(spark, validation.records(plan, tree, parents.withColumn("n", F.expr("case when page_index = 0 then 1 else n end")), marks))) == {"mcid_parent_tree"}
    assert set(failed(spark, validation.records(plan, tree, parents.filter("page_index <> 0"), marks))) == {"mcid_parent_tree", "reading_order_matches_plan"}


def test_documents_with_nothing_to_check(spark):
    nothing = tagtree.tagged_records(plan_of(spark).limit(0))
    assert failed(spark, nothing) == {}
    assert failed(spark, nothing, flags=(None, False)) == {"root_present": 1, "mark_info_marked": 1}
    assert failed(spark, tagtree.tagged_records(plan_of(spark, [(0, "P", 0, [], 0)]))) == {}


def test_without_a_plan(spark):
    _, tree, parents, marks = tables(spark, lambda t: t.filter("pos <> 7"))
    assert failed(spark, validation.records(None, tree, parents, marks), planned=False) == {}


def test_summary_and_role_counts(spark):
    docs = spark.createDataFrame([(1, True, True), (2, True, None)], "doc_id long, has_struct_tree boolean, mark_info_marked boolean")
    found = tagtree.tagged_records(plan_of(spark, alt=None))
    got = {r["doc_id"]: r for r in validation.validate(docs, found).collect()}
    assert [got[1][c] for c in ("status", "check_count", "passed_count", "failed_count")] == ["failed", 10, 9, 1]
    assert [got[1][c] for c in validation.COUNTS] == [11, 13, 19, 7, 1, 2, 1, 1]
    assert [got[2][c] for c in ("status", "failed_count", "nodes")] == ["failed", 1, 0]
    assert {r["role"]: r["n"] for r in validation.role_counts(found).collect()}["LI"] == 2


def test_one_row_of_records_for_each_of_plan_and_tree(spark):
    plan = plan_of(spark).unionByName(plan_of(spark, doc=2, k=11)).unionByName(plan_of(spark, doc=3, k=19))
    tree = tagtree.nodes(tagtree.with_struct_parents(plan))
    assert tagtree.tagged_records(plan, tagtree.damage, lambda key: key % 3 == 1).count() == plan.count() + tree.count()


def test_lost_places_and_entries_are_counted(spark):
    """A lost first heading moves every place behind it; its mark and the entries of gone links stay."""
    plan = plan_of(spark, [(0, "H1", 0, [], 0), (1, "P", 0, [], 0), (2, "H2", 0, [], 0)])
    found = tagtree.tagged_records(plan, lambda t: t.withColumn("gone", F.expr("pos = 0")))
    got = validation.evaluated(found).first()
    assert [got[c] for c in ("tops_wrong", "leaves_wrong", "tops", "tops_planned", "marks", "entries", "roles_short", "pages_short")] == [3, 3, 2, 3, 3, 2, 1, 1]


def test_content_ids_count_leaves_before(spark):
    plan = plan_of(spark, [(0, "P", 0, [], 0), (1, "Table", 0, [2, 1, 3], 1), (2, "LI", 0, [], 0), (3, "P", 1, [], 0), (4, "LI", 1, [], 0)])
    ids = [r["mcid"] for r in tagtree.nodes(plan).filter("is_leaf").orderBy("pos", "row", "cell").collect()]
    assert ids == [0, 1, 2, 3, 4, 5, 6, 7, 0, 1]
