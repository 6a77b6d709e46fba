"""Exact deduplication by skew-safe combining.

Copies meet in three steps, and full normalised texts are compared in each:
map-side aggregation within a task, aggregation over (digest, salt) with the
task's own salt, and aggregation of the salt winners over the digest. A group
of any size so reaches the last step as at most `salts` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize, meet


def normalized(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(body: Column) -> Column:
    return F.sha2(body, 256)


def exact_groups(docs: DataFrame, salts: int = 32) -> DataFrame:
    """One row per different normalised text: (digest, body, keep_id, group_size)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalized(F.col("text")).alias("body"))
    rows = rows.select("doc_id", "body", digest(F.col("body")).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "salt", "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = 32) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their whitespace-normalised contents are; of equal
    texts the row with the smallest doc_id stays. Null text counts as empty. A
    null doc_id is chosen only where a group has no other: then keep_id is null
    and all of the group's rows are kept. Rows repeating a doc_id and text are
    counted in group_size and share `kept`. Other columns are ignored. An empty
    table gives an empty result.
    """
    groups = exact_groups(docs, salts)
    found = materialize(groups.select("digest", "keep_id", "group_size"), "exact_groups")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalized(F.col("text")).alias("body"))
    rows = rows.select("doc_id", digest(F.col("body")).alias("digest"), F.col("body"))
    # Groups were made by content. Where each digest has one of them, which is looked at for all, the digest stands for it; else the content itself does.
    if found.groupBy("digest").count().filter("count > 1").limit(1).isEmpty():
        joined = meet(rows.drop("body"), found, "digest", "group_size", "doc_id")
    else:
        bodies = materialize(groups.select("body", "keep_id", "group_size"), "exact_bodies")
        joined = meet(rows, bodies, "body", "group_size", "doc_id")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))
