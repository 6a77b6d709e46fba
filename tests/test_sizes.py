"""Queries make and write no more than they need, and parts follow the table's rows."""

from __future__ import annotations

from cairn import registry
from cairn.operators import rebuild
from cairn.sources import shared

SMALL = "/root/testdata/sf0.001"


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: (calls.append(a), real(*a, **k))[1])
    return calls


def test_parts_follow_rows(spark):
    least = spark.sparkContext.defaultParallelism
    assert shared.parts(spark.range(10)) == least
    assert shared.parts(spark.range(1000), rows=10) == max(least, 100) and shared.parts(spark.range(1001), rows=10) == max(least, 101)


def test_a_scan_makes_one_plan(spark, monkeypatch):
    calls = counted(monkeypatch, rebuild, "structure_plan")
    registry.scanned(spark, SMALL)
    assert len(calls) == 1


def test_documents_need_no_plan(spark, monkeypatch):
    calls = counted(monkeypatch, rebuild, "structure_plan")
    assert registry.queries()["o1_documents"](spark, SMALL).count() > 0
    assert calls == []


def test_parent_tree_is_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "parts", lambda df, rows=100_000: 37)
    assert registry.dealt_plan(spark, SMALL).rdd.getNumPartitions() == 37


def test_reports_deal_each_table_once_and_write_nothing(spark, monkeypatch):
    calls = counted(monkeypatch, shared, "written")
    found = registry.queries()["p6_report_suggestions"](spark, SMALL)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert calls == [] and plan.count("Exchange hashpartitioning") == plan.count("FileScan parquet") == 2


def test_a_scan_writes_its_plan_alone(spark, monkeypatch):
    calls = counted(monkeypatch, shared, "written")
    found = registry.scanned(spark, SMALL)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [name for _, name, *_ in calls] == ["plan"] and plan.count("FileScan parquet [o_orderkey") == plan.count("ArrowEvalPython") == 1
