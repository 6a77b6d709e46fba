"""A corpus pipeline: toxicity filter, exact and near deduplication, repeated-string removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read back as the next one's docs.

What holds for all stages: columns beside those of documents are left out and
missing ones are null; a null text counts as empty; an empty table gives an
empty result. Rows are told apart even where ids are null or repeated: each has
its own text and its own decision, and "first" is by doc_id with nulls last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import exact_dedup, jaccard_join, packing, suffix_dedup, toxicity
from cairn.llm.common import by_row, give_back, materialize, small_batches
from cairn.llm.queries import WORD_TOKENIZER, table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KINDS = ["long", "string", "string", "string", "long"]


def shaped(docs: DataFrame) -> DataFrame:
    """The columns of documents, null where docs lacks them."""
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in zip(COLUMNS, KINDS, strict=True)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the scorer, fitted on labelled rows, does not call toxic, repeated ones and such with null ids or texts too."""
    rows = shaped(docs)
    strength, grams = toxicity.fit(rows, table(spark, sf_dir, "labels"))
    learnt = spark.sparkContext.broadcast((strength, grams))
    small_batches(spark)

    def run(batches):
        import pyarrow as pa

        scorer = toxicity.Scorer(*learnt.value)
        for b in batches:
            clean = [scorer.score(t or "") < 0.5 for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))
        del scorer
        give_back()

    return rows.mapInArrow(run, rows.schema)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, also such that repeat an id, the first."""
    rows = by_row(shaped(docs))
    kept = exact_dedup.exact_groups(rows.select(F.col("row_key").alias("doc_id"), "text")).select(F.col("keep_id").alias("row_key"))
    return rows.hint("merge").join(kept, "row_key").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the first; rows without words are linked to none and stay."""
    rows = by_row(shaped(docs))
    groups = jaccard_join.jaccard_join(rows.select(F.col("row_key").alias("doc_id"), "text"))
    kept = materialize(groups.filter("doc_id = class_id").select(F.col("doc_id").alias("row_key")), "kept")
    return rows.hint("merge").join(kept, "row_key").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier in the corpus; every row stays."""
    rows = by_row(shaped(docs))
    cut = suffix_dedup.suffix_dedup(rows.select(F.col("row_key").alias("doc_id"), "text"), decoded=True)
    kept = cut.select(F.col("doc_id").alias("row_key"), F.col("kept").alias("text"))
    return kept.hint("merge").join(rows.drop("text", "n_chars"), "row_key").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; each row is packed, repeated ones as often as they are there."""
    return packing.pack(shaped(docs), vocabulary(WORD_TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("best_fit_packing", pack),
]
#: Scores, similarity groups and tokens are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents to packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
