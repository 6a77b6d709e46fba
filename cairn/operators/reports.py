"""Counts, comparisons and report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(issues: DataFrame) -> DataFrame:
    """Counts by status, severity and type in one scan: (doc_id, kind, name, n)."""
    sets = issues.groupingSets([["doc_id", "automation_status"], ["doc_id", "severity"], ["doc_id", "issue_type"]], "doc_id", "automation_status", "severity", "issue_type").agg(F.count(F.lit(1)).cast("long").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "automation_status").when(F.col("g") == 5, "severity").otherwise("issue_type")
    return sets.select("doc_id", kind.alias("kind"), F.coalesce("automation_status", "severity", "issue_type").alias("name"), "n")


def count_by(issues: DataFrame, *columns: str) -> DataFrame:
    return issues.groupBy(*columns).agg(F.count(F.lit(1)).cast("long").alias("n"))


def issue_counts(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues of each document, 0 for clean ones."""
    n = issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return documents.select("doc_id").distinct().join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("issues"))


def before_after(source: DataFrame, regenerated: DataFrame) -> DataFrame:
    """(doc_id, bucket, issue_type, n) with buckets rejected, fixed, remaining and manual; fixed goes by type, not by issue.

    Both sides are counted by (doc_id, issue_type) in one aggregate, from which all buckets follow.
    """
    none = F.lit(None).cast("string")
    both = source.select("doc_id", "issue_type", "final_status", none.alias("again")).unionByName(regenerated.select("doc_id", "issue_type", none.alias("final_status"), F.col("automation_status").alias("again")))
    n = both.groupBy("doc_id", "issue_type").agg(
        F.count_if(F.col("final_status") == "rejected").alias("rejected"), F.count_if(F.col("final_status") != "rejected").alias("kept"), F.count("again").alias("remaining"),
        F.count_if(F.col("again").isin("needs_user_confirmation", "cannot_automate")).alias("manual"),
    )
    fixed = F.when(F.col("remaining") == 0, F.col("kept")).otherwise(0)
    buckets = F.array(*[F.struct(F.lit(name).alias("bucket"), c.cast("long").alias("n")) for name, c in (("rejected", F.col("rejected")), ("fixed", fixed), ("remaining", F.col("remaining")), ("manual", F.col("manual")))])
    return n.select("doc_id", "issue_type", F.explode(buckets).alias("b")).select("doc_id", "b.bucket", "issue_type", "b.n").filter("n > 0")


def report_json(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, report): one JSON report per document: counts by status, severity and type, and the issues; all empty where there are none."""
    listed = issues.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("issue_ord", "issue_type", "severity", "automation_status"))).alias("issues"))
    maps = counts(issues).groupBy("doc_id", "kind").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("m"))
    maps = maps.groupBy("doc_id").agg(*[F.first(F.when(F.col("kind") == k, F.col("m")), ignorenulls=True).alias(f"by_{k}") for k in ("automation_status", "severity", "issue_type")])
    rows = documents.select("doc_id").distinct().join(listed, "doc_id", "left").join(maps, "doc_id", "left")
    none = F.create_map().cast("map<string,bigint>")
    parts = [F.coalesce(f"by_{k}", none).alias(f"by_{k}") for k in ("automation_status", "severity", "issue_type")]
    return rows.select("doc_id", F.to_json(F.struct(F.coalesce(F.size("issues"), F.lit(0)).alias("issue_count"), *parts, F.coalesce("issues", F.array().cast("array<struct<issue_ord:bigint,issue_type:string,severity:string,automation_status:string>>")).alias("issues"))).alias("report"))
