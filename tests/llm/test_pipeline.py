"""The pipeline's stages against what they should keep."""

from __future__ import annotations

import pytest

import corpus_pipeline
from cairn.llm.common import materialize
from tests.llm.test_ops import brute_join, brute_repeats

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SMALL), name)
        kept[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    texts = lambda n: {r["doc_id"]: r["text"] for r in kept[n].collect()}
    clean, once = texts("toxicity"), texts("exact_dedup")
    norm = {}
    for d in sorted(clean):
        norm.setdefault(" ".join((clean[d] or "").split(" ")), d)
    assert len(once) <= len(clean) and set(once) <= set(clean)
    groups = brute_join(once)
    assert set(texts("jaccard_join")) == {d for d, (g, _) in groups.items() if g == d}
    left = brute_repeats(texts("jaccard_join"))
    cut = texts("suffix_dedup")
    assert set(cut) == set(left)
    assert all(len(cut[d].encode()) <= left[d][0] - left[d][1] for d in cut)
    packed = kept["best_fit_packing"].collect()
    assert {r["doc_id"] for r in packed} == set(cut)


ODD = [(1, "a a"), (2, "b"), (2, "a a"), (3, "d"), (3, "d"), (None, "d"), (None, "only here"), (4, None), (5, ""), (None, None), (6, "x y " * 40_000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeated ids with equal and with other texts, a very long text, a column too many and two missing."""
    return spark.createDataFrame([(*r, "z", 0) for r in ODD], "doc_id long, text string, source string, row_key int").repartition(3)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=str)


def test_copies_on_odd_rows(spark, odd):
    got = corpus_pipeline.drop_copies(spark, odd, SMALL)
    assert got.columns == corpus_pipeline.COLUMNS
    assert rows_of(got) == sorted([(1, "a a"), (2, "b"), (3, "d"), (None, "only here"), (4, ""), (6, "x y " * 40_000)], key=str)


def test_near_copies_on_odd_rows(spark, odd):
    got = rows_of(corpus_pipeline.drop_near_copies(spark, odd, SMALL))
    # Texts without words stay; of equal ones the first does.
    assert got == sorted([(1, "a a"), (2, "b"), (3, "d"), (None, "only here"), (4, ""), (5, ""), (None, ""), (6, "x y " * 40_000)], key=str)


def test_repeats_on_odd_rows(spark, odd):
    got = rows_of(corpus_pipeline.cut_repeats(spark, odd, SMALL))
    want = [(d, t or "") for d, t in ODD if d != 6]
    assert sorted((r for r in got if r[0] != 6), key=str) == sorted(want, key=str)
    n, removed, *_ = brute_repeats({6: "x y " * 1000})[6]
    assert [len(t) for d, t in got if d == 6] == [n - removed]  # four bytes go before the first string that is met again, in a longer text as well


def test_toxic_and_packed_odd_rows(spark, odd):
    clean = corpus_pipeline.drop_toxic(spark, odd, SMALL)
    assert rows_of(clean) == sorted([(d, t or "") for d, t in ODD], key=str)
    pieces = corpus_pipeline.pack(spark, odd, SMALL).collect()
    assert sum(r["piece"] == 0 for r in pieces) == len(ODD)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_an_empty_table(spark, odd, k):
    assert corpus_pipeline.STAGES[k][1](spark, odd.limit(0), SMALL).count() == 0
