"""The store of jobs: versions, writers at once, decisions that all count or none."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from cairn.operators import jobs, review

ASKED = "job_id long, seq long, slot long, issue long, decision string, final_value string"


@pytest.fixture
def store(spark, tmp_path):
    made = jobs.JobStore(spark, f"file://{tmp_path}/jobs", buckets=4)
    rows = spark.range(12).select(F.col("id").alias("job_id"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("slot")).withColumn("issue", F.col("slot") + 10).withColumn("proposed_value", F.lit("p"))
    made.create(jobs.result_json(rows))
    return made


def status(store, version=None):
    return {r["job_id"]: r["status"] for r in store.read(version).collect()}


def test_created_jobs(spark, store):
    assert store.version() == 1 and set(status(store).values()) == {"awaiting_review"} and len(status(store)) == 12
    with pytest.raises(jobs.JobNotFound):
        store.get(99)
    for ids in ([3, 50], [60, 60]):
        with pytest.raises(jobs.JobExists):
            store.create(spark.createDataFrame([(k, "{}") for k in ids], "job_id long, result string"))
    assert store.version() == 1 and len(status(store)) == 12
    store.create(spark.createDataFrame([(50, "{}")], "job_id long, result string"))
    assert len(status(store)) == 13 and len(status(store, 1)) == 12


def test_an_empty_store(spark, tmp_path):
    empty = jobs.JobStore(spark, f"file://{tmp_path}/none")
    assert empty.version() == 0 and empty.read().count() == 0
    with pytest.raises(jobs.JobNotFound):
        empty.get(1)


def test_a_save_from_an_old_version_conflicts(store):
    old = store.version()
    store.save(store.get(3).withColumn("status", F.lit("reviewed")), old)
    store.save(store.get(4, old).withColumn("status", F.lit("reviewed")), old)  # another job, whichever bucket it is in
    with pytest.raises(jobs.Conflict):
        store.save(store.get(3, old).withColumn("status", F.lit("lost")), old)
    with pytest.raises(jobs.JobNotFound):
        store.save(store.get(3).withColumn("job_id", F.lit(77).cast("long")), store.version())
    got = status(store)
    assert (got[3], got[4], store.version(), len(got)) == ("reviewed", "reviewed", 3, 12)


def test_a_writer_between_is_taken_up(spark, store, monkeypatch):
    """Another writer commits after our files are made and before our claim: nothing of either is lost."""
    other, claim, once = jobs.JobStore(spark, store.root, 4), store._claim, []

    def late(version, buckets):
        if not once:
            once.append(version)
            other.update(lambda rows: rows.filter("job_id < 6").withColumn("status", F.lit("theirs")))
        return claim(version, buckets)

    monkeypatch.setattr(store, "_claim", late)
    store.update(lambda rows: rows.filter("job_id >= 6").withColumn("status", F.lit("ours")))
    got = status(store)
    assert {k: v for k, v in got.items() if k < 6} == dict.fromkeys(range(6), "theirs")
    assert {k: v for k, v in got.items() if k >= 6} == dict.fromkeys(range(6, 12), "ours")
    assert once == [2] and store.version() == 3


def test_writers_at_once(spark, store):
    def add(k):
        mine = jobs.JobStore(spark, store.root, 4)
        kind = spark.createDataFrame([(1, (f"a{k}", "accessible_pdf", "f", "p", "now", "{}"))], f"job_id long, artifact {jobs.ARTIFACT}")
        mine.add_artifacts(kind)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = store.get(1).first()
    assert sorted(a["id"] for a in got["artifacts"]) == ["a0", "a1", "a2"] and got["status"] == "output_generated"
    assert store.version() == 4


def test_decisions(spark, store):
    assert store.apply_decisions(spark.createDataFrame([], ASKED)) is None and store.version() == 1
    store.apply_decisions(spark.createDataFrame([(1, 1, 0, 10, "reject", None), (1, 2, 0, 10, "edit", "mine"), (1, 3, 1, 11, "accept", None), (2, 1, 1, 11, "reject", None)], ASKED))
    got = {r["job_id"]: r for r in jobs.opened(store.read()).collect()}
    assert [i["final_status"] for i in got[1]["issues"]] == ["accepted", "accepted"] and got[1]["status"] == "reviewed"
    assert [(e["event_seq"], e["decision"], e["final_value"]) for e in got[1]["audit_events"]] == [(1, "reject", None), (2, "edit", "mine"), (3, "accept", None)]
    assert [i["final_status"] for i in got[2]["issues"]] == ["open", "rejected"] and got[2]["status"] == "awaiting_review"
    store.apply_decisions(spark.createDataFrame([(2, 9, 0, 10, "accept", None)], ASKED))
    assert [e["event_seq"] for e in jobs.opened(store.get(2)).first()["audit_events"]] == [1, 2] and status(store)[2] == "reviewed"


@pytest.mark.parametrize(("row", "error"), [((1, 1, 5, 10, "accept", None), review.ReviewError), ((1, 1, 0, 11, "accept", None), review.ReviewError), ((1, 1, 0, 99, "accept", None), review.ReviewError), ((77, 1, 0, 10, "accept", None), jobs.JobNotFound)])
def test_all_decisions_or_none(spark, store, row, error):
    with pytest.raises(error):
        store.apply_decisions(spark.createDataFrame([(1, 0, 0, 10, "accept", None), row], ASKED))
    assert store.version() == 1


@pytest.mark.parametrize(("slot", "issue", "problem"), [(3, 0, "unknown suggestion"), (0, 1, "mismatch"), (1, 1, "unknown issue")])
def test_what_is_wrong_with_a_decision(spark, slot, issue, problem):
    asked = spark.createDataFrame([(1, 1, 0, 0, "accept"), (1, 2, slot, issue, "accept")], "job_id long, seq long, slot long, issue long, decision string")
    known = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "job_id long, slot long, of_issue long")
    with pytest.raises(review.ReviewError, match=problem):
        review.apply_decisions(spark.createDataFrame([(1, 0, 0)], "job_id long, slot long, issue long"), asked, known)
