"""Layout of positioned lines: medians, overlaps, neighbours, columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import lines_of, strip


def page_median(lines: DataFrame) -> DataFrame:
    """Exact median of non-zero font sizes of each page, 0 where there is none."""
    size = F.when(F.col("font_size") != 0, F.col("font_size"))
    return lines.groupBy("doc_id", "page_number").agg(F.coalesce(F.median(size), F.lit(0.0)).alias("body_size"))


def heading(text: Column, size: Column, body: Column, line_count: Column | None = None) -> Column:
    lines = F.lit(1) if line_count is None else line_count
    upper = (text == F.upper(text)) & (text != F.lower(text)) & (F.size(F.split(strip(text), r"(?U)\s+")) <= 10)
    return (F.length(text) <= 120) & (lines <= 2) & (((body > 0) & (size >= body + 2)) | upper)


def heading_level(size: Column, body: Column) -> Column:
    return F.when((body > 0) & (size >= body + 8), 1).when((body > 0) & (size >= body + 4), 2).otherwise(3)


def table_text(text: Column) -> Column:
    """Whether text looks like a table: two lines or more, and two or more with a tab or two spaces."""
    lines = lines_of(text)
    return (F.size(lines) >= 2) & (F.size(F.filter(lines, lambda x: x.contains("\t") | x.contains("  "))) >= 2)


def table_headers(text: Column) -> Column:
    """Cells of the first line: by tabs, else by two spaces."""
    first = F.coalesce(F.get(lines_of(text), F.lit(0)), F.lit(""))
    cells = F.when(first.contains("\t"), F.split(first, "\t")).otherwise(F.split(first, "  "))
    return F.filter(F.transform(cells, strip), lambda x: x != "")


def block_confidence(line_count: Column) -> Column:
    return F.when(line_count == 1, 0.85).otherwise(0.8)


def box(rect: Column) -> Column:
    """(x0, y0, x1, y1) as doubles of a rectangle in JSON: a list of four numbers or more, or an object of those names; null for anything else."""
    v = F.try_parse_json(rect)
    number = lambda path: F.try_variant_get(v, path, "double")
    listed, named = [number(f"$[{k}]") for k in range(4)], [number(f"$.{c}") for c in ("x0", "y0", "x1", "y1")]
    whole = lambda cols: F.when(~F.exists(F.array(*cols), lambda x: x.isNull()), F.array(*cols))
    return F.coalesce(whole(listed), whole(named))


def image_rows(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images (doc_id, page_number, pos) with the box that has their number on the page, if there is one.

    boxes (doc_id, page_number, ord, x0, y0, x1, y1) counts every drawing, so an
    image that is drawn twice shifts the boxes of those behind it.
    """
    nth = (F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("pos")) - 1).cast("long")
    rows = images.select("doc_id", "page_number", "pos").withColumn("ord", nth).join(boxes, ["doc_id", "page_number", "ord"], "left")
    name = F.concat(F.col("page_number").cast("string"), F.lit(":image:"), (F.col("ord") + 1).cast("string"))
    return rows.select("doc_id", "pos", name.alias("element_id"), F.lit(0.65).alias("confidence"), "x0", "y0", "x1", "y1")


def link_rows(elements: DataFrame) -> DataFrame:
    """Links with the text of the lines that their box touches, else their address; those without an address are little trusted."""
    rows = elements.filter("type = 'link'").select("doc_id", F.col("pos").alias("link_pos"), F.nullif("href", F.lit("")).alias("href")).join(link_texts(elements), ["doc_id", "link_pos"])
    text = F.coalesce(F.nullif(strip(F.col("texts")), F.lit("")), "href", F.lit(""))
    return rows.select("doc_id", F.col("link_pos").alias("pos"), text.alias("text"), F.when((text != "") & F.col("href").isNotNull(), 0.85).otherwise(0.45).alias("confidence"))


def text_lines(elements: DataFrame) -> DataFrame:
    """The elements that are lines of text: neither images nor links."""
    return elements.filter(~F.col("type").isin("image", "link"))


def link_texts(elements: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """For each link the texts of the lines that its box touches, in order: equi-join on the page, four inequalities.

    lines are the elements that are looked at: lines of text, or what is given.
    """
    links = elements.filter("type = 'link'").select("doc_id", "page_number", F.col("pos").alias("link_pos"), *[F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")])
    lines = (text_lines(elements) if lines is None else lines).select("doc_id", "page_number", "pos", "text", "x0", "y0", "x1", "y1")
    touch = (F.col("x0") <= F.col("l_x1")) & (F.col("x1") >= F.col("l_x0")) & (F.col("y0") <= F.col("l_y1")) & (F.col("y1") >= F.col("l_y0"))
    lines = lines.withColumnRenamed("doc_id", "l_doc").withColumnRenamed("page_number", "l_page")
    met = links.join(lines, (F.col("doc_id") == F.col("l_doc")) & (F.col("page_number") == F.col("l_page")) & touch, "left")
    listed = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "text")))
    return met.groupBy("doc_id", "link_pos").agg(F.array_join(F.transform(F.sort_array(listed), lambda x: x["text"]), " ").alias("texts"), F.count("pos").cast("long").alias("lines"))


def nearby(elements: DataFrame, k: int = 2, limit: int = 160, lines: DataFrame | None = None) -> DataFrame:
    """For each image the texts of the k nearest lines of its page by Manhattan distance of centres, ties in reading order.

    lines are the elements that are looked at: lines of text, or what is given.
    """
    images = elements.filter("type = 'image'").select("doc_id", "page_number", F.col("pos").alias("image_pos"), (F.col("x0") + F.col("x1")).alias("cx"), (F.col("y0") + F.col("y1")).alias("cy"))
    lines = (text_lines(elements) if lines is None else lines).select("doc_id", "page_number", "pos", "text", "x0", "y0", "x1", "y1")
    far = (F.abs(F.col("x0") + F.col("x1") - F.col("cx")) + F.abs(F.col("y0") + F.col("y1") - F.col("cy"))) / 2
    near = images.join(lines, ["doc_id", "page_number"], "left").withColumn("far", far)
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "image_pos").orderBy("far", "pos"))).filter(F.col("rn") <= k)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("rn", "text")))), lambda x: x["text"]), " ")
    return near.groupBy("doc_id", "image_pos").agg(strip(F.substring(text, 1, limit)).alias("nearby_text"))


def multi_column(lines: DataFrame, keys: list[str], least: int = 6, gap: int = 48, spread: int = 120) -> DataFrame:
    """Whether each page has columns: left edges clustered in order against the running cluster's median.

    The fold holds where the cluster begins in the sorted edges, so its work is in proportion to the page's lines.
    """
    edges = lines.filter("x0 is not null").groupBy(*keys).agg(F.sort_array(F.collect_list("x0")).alias("edges"))
    at = lambda i: F.get(F.col("edges"), i.cast("int"))
    middle = lambda s: (at(s["low"] + F.floor((s["i"] - s["low"] - 1) / 2)) + at(s["low"] + F.floor((s["i"] - s["low"]) / 2))) / 2
    state = lambda low, i, n, first, last: F.struct(low.cast("int").alias("low"), i.cast("int").alias("i"), n.cast("int").alias("n"), first.cast("double").alias("first"), last.cast("double").alias("last"))

    def closed(s, when, low, i):
        """The state behind a cluster's end; only clusters of two edges or more count."""
        counts = when & (s["i"] - s["low"] >= 2)
        return state(low, i, s["n"] + counts.cast("int"), F.when(counts & s["first"].isNull(), middle(s)).otherwise(s["first"]), F.when(counts, middle(s)).otherwise(s["last"]))

    def step(s, x):
        fresh = F.coalesce((s["i"] > s["low"]) & (F.abs(x - middle(s)) > gap), F.lit(False))
        return closed(s, fresh, F.when(fresh, s["i"]).otherwise(s["low"]), s["i"] + 1)

    zero, none = F.lit(0), F.lit(None)
    rows = edges.withColumn("s", F.aggregate("edges", state(zero, zero, zero, none, none), step, lambda s: closed(s, F.lit(True), s["low"], s["i"])))
    wide = (F.size("edges") >= least) & (F.col("s.n") >= 2) & (F.col("s.last") - F.col("s.first") > spread)
    return rows.select(*keys, F.size("edges").cast("long").alias("lines"), F.coalesce(wide, F.lit(False)).alias("multi_column"))
