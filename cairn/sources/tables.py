"""Adapters: the provided tables as documents, elements, decisions and inspections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.text import is_upper, strip

KINDS = ["heading", "image", "link", "table", "list_item", "paragraph"]
TEXTS = ["click here", " Read More ", "https://example.com/a", "www.example.org", "", "HERE", "Annual report", "Contact the team", "Budget, by year", "Find a form"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_elements(docs: DataFrame) -> DataFrame:
    """Text documents: a non-blank line is a HEADING of level 3 if it looks like one, else a PARAGRAPH."""
    lines = docs.select("doc_id", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"))
    t = strip(F.col("raw"))
    head = (F.length(t) <= 120) & is_upper(t) & (F.size(F.split(t, r"(?U)\s+")) <= 10)
    return lines.filter(t != "").select("doc_id", F.col("line").cast("long").alias("pos"), t.alias("text"), F.when(head, "heading").otherwise("paragraph").alias("type"))


def page_links(pages: DataFrame) -> DataFrame:
    """Links of web pages: (doc_id, pos, href, text); scripts, styles and comments are cut first."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    tags = F.regexp_extract_all(body, F.lit(r'(?is)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    links = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(tags).alias("pos", "tag"))
    inner = strip(F.regexp_replace("tag", r"(?s)<[^>]*>", ""))
    return links.select("doc_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("tag", r'(?i)href="([^"]*)"', 1).alias("href"), inner.alias("text"))


def order_elements(lineitem: DataFrame) -> DataFrame:
    """Synthetic elements, one per line item, in a stable order within their order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    k = F.col("l_suppkey")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    rows = lineitem.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    rows = rows.select(
        F.col("l_orderkey").alias("doc_id"), "pos", k.alias("k"),
        pick(KINDS, F.col("l_quantity").cast("long") % 6).alias("type"), pick(TEXTS, k % 10).alias("text"),
        (F.col("l_partkey") % 6 + 1).cast("long").alias("heading_level"), F.round(1 - 5 * F.col("l_discount"), 6).alias("confidence"),
        F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.lit("")).otherwise(F.lit("A picture")).alias("alt_text"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(" Budget"), F.lit("BY YEAR"))).alias("table_headers"), F.when(k % 3 == 0, F.lit(" * ")).alias("list_label"),
        (F.col("l_tax") > 0.06).alias("decorative"), F.when(k % 4 == 0, F.lit(0)).otherwise(F.lit(2)).cast("long").alias("n_headers"),
        (F.floor(F.col("pos") / 4) + 1).cast("long").alias("page_number"), (11 + F.col("l_partkey") % 10).cast("double").alias("font_size"),
        F.when(k % 2 == 0, F.concat(F.lit("e"), (k % 7).cast("string"))).alias("element_id"),
        F.when(k % 4 == 1, F.concat(F.lit("https://example.com:8080/a"), k.cast("string"))).when(k % 4 == 2, F.lit("http://data.example.org/x")).when(k % 4 == 3, F.lit("mailto:a@b.c")).alias("href"),
        F.when(k % 5 == 0, F.concat(F.lit("Nearby "), k.cast("string"))).otherwise(F.lit("")).alias("nearby_text"),
        (72 + 64 * (k % 5)).cast("double").alias("x0"), (72 + 24 * F.col("pos")).cast("double").alias("y0"),
    )
    return rows.withColumn("x1", F.col("x0") + 130).withColumn("y1", F.col("y0") + 60)


def inspection_columns() -> dict[str, Column]:
    """Columns of an order's row that make an inspection of it."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    third = lambda c: F.when(c % 3 == 0, F.lit(True)).when(c % 3 == 1, F.lit(False))
    return {
        "is_encrypted": key % 11 == 0, "has_struct_tree": third(key), "mark_info_marked": third(cust),
        "page_count": (key % 4).cast("long"), "text_block_count": (key % 5).cast("long"),
        "multi_column_pages": F.filter(F.array(F.when(key % 6 == 0, F.lit(1)), F.when(key % 9 == 0, F.lit(3))), lambda x: x.isNotNull()),
        "language": F.when(key % 8 == 0, F.lit(" ")).when(key % 8 != 1, F.lit("en")),
    }


def order_inspections(orders: DataFrame) -> DataFrame:
    """A document inspection for each order."""
    return orders.select(F.col("o_orderkey").alias("doc_id"), *[c.alias(name) for name, c in inspection_columns().items()])


def event_decisions(events: DataFrame) -> DataFrame:
    """Decisions from the event log: a job is a user, a suggestion a slot of five; seq is the order of time."""
    kind = F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "purchase", "edit").when(F.col("event_type") == "error", "reject")
    rows = events.select(F.col("user_id").alias("job_id"), "ts", "event_id", kind.alias("decision"), F.pmod(F.floor("value"), F.lit(5)).cast("long").alias("slot"), "props").filter("decision is not null")
    seq = F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "event_id")).cast("long")
    return rows.withColumn("seq", seq).select("job_id", "seq", "slot", "decision", F.when(F.col("decision") == "edit", F.col("props")).alias("final_value"))
