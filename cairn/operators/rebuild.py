"""The rebuild plan: content, roles, heights, pages."""

from __future__ import annotations

import textwrap
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.text import cleaned, folded, has_table_rows, strip, table_rows

RENDERED = ["heading", "paragraph", "list_item", "table", "image", "link"]


def role() -> Column:
    t = F.col("type")
    level = F.least(F.greatest(F.coalesce("heading_level", F.lit(1)), F.lit(1)), F.lit(6)).cast("string")
    return F.when(t == "heading", F.concat(F.lit("H"), level)).when(t == "link", "Link").when(t == "list_item", "LI").when(t == "table", "Table").when(t == "image", "Figure").otherwise("P")


def has_content() -> Column:
    """Images always, tables with rows or headers, other elements with text."""
    t = F.col("type")
    shown = F.when(t == "image", True).when(t == "table", has_table_rows(F.col("text"), F.col("table_headers"))).otherwise(cleaned(F.col("text")).isNotNull())
    return t.isin(RENDERED) & shown


def list_label(label: Column) -> Column:
    """What stands before a list item: its own label, else a dash; nothing before other elements."""
    return F.when(F.col("type") == "list_item", F.coalesce(cleaned(label), F.lit("-"))).otherwise(F.lit(""))


def duplicate_texts(elements: DataFrame) -> DataFrame:
    """Elements whose text is a link's, ignoring case, and whose box overlaps it by an area."""
    key = folded(strip(F.col("text")))
    links = elements.filter("type = 'link'").select("doc_id", key.alias("key"), *[F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")])
    over = (F.col("x0") < F.col("l_x1")) & (F.col("x1") > F.col("l_x0")) & (F.col("y0") < F.col("l_y1")) & (F.col("y1") > F.col("l_y0"))
    texts = elements.filter("type <> 'link'").withColumn("key", key).filter("key <> ''")
    same = (texts.doc_id == links.doc_id) & (texts.key == links.key) & over
    return texts.join(links, same, "left_semi").drop("key")


def content(elements: DataFrame) -> DataFrame:
    """Elements that are rendered: those with content but no texts that a link repeats at its place; one anti join."""
    key = F.nullif(folded(strip(F.col("text"))), F.lit(""))
    links = elements.filter("type = 'link'").select(F.col("doc_id").alias("l_doc"), key.alias("l_key"), *[F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")])
    over = (F.col("x0") < F.col("l_x1")) & (F.col("x1") > F.col("l_x0")) & (F.col("y0") < F.col("l_y1")) & (F.col("y1") > F.col("l_y0"))
    shown = elements.filter(has_content()).withColumn("key", F.when(F.col("type") != "link", key))
    return shown.join(links, (F.col("doc_id") == F.col("l_doc")) & (F.col("key") == F.col("l_key")) & over, "left_anti").drop("key")


def with_lines(rows: DataFrame, width: int = 72) -> DataFrame:
    """rows (with text) and how many lines greedy word wrapping gives; Arrow batches around the standard library."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n = [max(1, len(textwrap.wrap(t or "", width))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [*b.schema.names, "lines"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lines", T.LongType())]))


def wrapped_lines(texts: DataFrame, width: int = 72) -> DataFrame:
    """(doc_id, pos, lines) of texts."""
    return with_lines(texts.select("doc_id", "pos", "text"), width).drop("text")


#: The page's left edge and width, where pages begin and the last place where an element may begin.
LEFT, WIDTH, TOP, BOTTOM = 72.0, 451.0, 72.0, 760.0
LINE = "struct<text:string,x:double,y:double,size:double>"
LAID = f"page_index long, y double, block_count long, lines array<{LINE}>"


def _wrapped(text: str, width: int) -> list[str]:
    """textwrap.wrap, which leaves a short text without odd white space as it is."""
    return [text] if 0 < len(text) <= width and text.isprintable() and text[-1] != " " else textwrap.wrap(text, width)


def _text_lines(text: str, level: int | None, y: float) -> tuple[list[tuple], float]:
    """Lines of a text element, level 0 where it is no heading, and its height."""
    size, step = {0: (11.0, 16.0), 1: (18.0, 24.0)}.get(level, (14.0, 20.0))
    lines = _wrapped(text, 72) or [text]
    return [(x, LEFT, y + k * step, size) for k, x in enumerate(lines)], step * len(lines) + 8


def _image_lines(alt: str | None, decorative: bool, y: float) -> tuple[list[tuple], float]:
    """The label in an image's frame: three lines at most; the frame's height is fixed."""
    label = "Decorative image" if decorative else f"Figure: {alt}" if alt else "Figure: alt text requires review"
    lines = _wrapped(label.replace("\n", " ").strip(), 68)[:3]
    return [(x, LEFT + 10, y + 20 + 14 * k, 10.0) for k, x in enumerate(lines)], 76.0


def _table_lines(cells: list[list[str]], y: float) -> tuple[list[tuple], float]:
    """A table's cells in columns of one width, each cut to what fits."""
    wide = WIDTH / max([1, *map(len, cells)])
    fit = lambda x: x if len(x) <= 28 else f"{x[:25]}..."
    return [(fit(x.replace("\n", " ").strip()), LEFT + k * wide + 4, y + 24 * r + 15, 9.0) for r, row in enumerate(cells) for k, x in enumerate(row) if x], 24.0 * len(cells) + 12


def laid_out(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows with page_index, y, block_count and lines: one fold over each document's elements, as a page's end depends on all before.

    rows: (doc_id, pos, type, heading_level, text, cells, alt, decorative, ...),
    where text is what is written and cells a table's rows. They are dealt by
    document once (into so many parts, or as Spark sees fit) and pass in order;
    only the cursor is held, so a document of any length takes one pass. An element that begins on a page ends on it.
    """
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(LAID).fields])

    def run(batches):
        import pyarrow as pa

        doc, y, page = None, TOP, 0
        for b in batches:
            pages, tops, counts, flat = [], [], [], []
            for d, kind, level, text, cells, alt, plain in zip(*(b.column(c).to_pylist() for c in ("doc_id", "type", "heading_level", "text", "cells", "alt", "decorative")), strict=True):
                if d != doc:
                    doc, y, page = d, TOP, 0
                if y > BOTTOM:
                    y, page = TOP, page + 1
                if kind == "image":
                    lines, high = _image_lines(alt, plain, y)
                elif kind == "table":
                    lines, high = _table_lines(cells or [], y)
                else:
                    lines, high = _text_lines(text or "", (2 if level is None else level) if kind == "heading" else 0, y)
                pages.append(page)
                tops.append(y)
                counts.append(len(lines))
                flat += lines
                y += high
            columns = zip(*flat, strict=True) if flat else ((), (), (), ())
            line = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["text", "x", "y", "size"])
            new = [pa.array(pages, pa.int64()), pa.array(tops, pa.float64()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array([0, *accumulate(counts)], pa.int32()), line)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "page_index", "y", "block_count", "lines"])

    return _dealt(rows, parts).mapInArrow(run, schema)


def _dealt(rows: DataFrame, parts: int | None) -> DataFrame:
    return (rows.repartition("doc_id") if parts is None else rows.repartition(parts, "doc_id")).sortWithinPartitions("doc_id", "pos")


def paged(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows with the page_index that laid_out gives them, without what is written there: heights alone, of whole batches.

    rows: (doc_id, pos, type, heading_level, text, row_sizes, ...).
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("page_index", T.LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        doc, y, page = None, TOP, 0
        for b in batches:
            kind, text = b.column("type"), pc.fill_null(b.column("text"), "")
            of = lambda name: pc.fill_null(pc.equal(kind, name), False).to_numpy(zero_copy_only=False)
            image, table, heading = of("image"), of("table"), of("heading")
            n = np.ones(len(kind), np.int64)
            long = pc.or_(pc.greater(pc.utf8_length(text), 72), pc.match_substring(text, "\t")).to_numpy(zero_copy_only=False) & ~image & ~table  # others are one line
            for i in np.flatnonzero(long).tolist():
                n[i] = max(1, len(textwrap.wrap(text[i].as_py(), 72)))
            first = heading & (pc.fill_null(b.column("heading_level"), 2).to_numpy(zero_copy_only=False) == 1)
            none = heading & (pc.fill_null(b.column("heading_level"), 2).to_numpy(zero_copy_only=False) == 0)
            step = np.where(first, 24.0, np.where(heading & ~none, 20.0, 16.0))
            sizes = pc.fill_null(pc.list_value_length(b.column("row_sizes")), 0).to_numpy(zero_copy_only=False)
            high = np.where(image, 76.0, np.where(table, 24.0 * sizes + 12, step * n + 8))
            pages = []
            for d, h in zip(b.column("doc_id").to_pylist(), high.tolist(), strict=True):
                if d != doc:
                    doc, y, page = d, TOP, 0
                if y > BOTTOM:
                    y, page = TOP, page + 1
                pages.append(page)
                y += h
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pages, pa.int64())], [*b.schema.names, "page_index"])

    return _dealt(rows, parts).mapInArrow(run, schema)


def tag_plan(elements: DataFrame, parts: int | None = None) -> DataFrame:
    """What tag trees take of structure_plan: (doc_id, pos, role, page_index, row_sizes, n_headers, alt_text, decorative, k), with the same values."""
    rows = content(elements)
    rows = rows.select("doc_id", "pos", "type", "heading_level", _shown().alias("text"), F.transform(_cells(), F.size).alias("row_sizes"), "n_headers", "alt_text", "decorative", "k")
    return paged(rows, parts).select("doc_id", "pos", role().alias("role"), "page_index", "row_sizes", "n_headers", "alt_text", "decorative", "k")


def _cells() -> Column:
    return F.when(F.col("type") == "table", table_rows(F.col("text"), F.col("table_headers"))).otherwise(F.array().cast("array<array<string>>"))


def _shown() -> Column:
    """Text as it is written: stripped, and behind its label in a list."""
    label = list_label(F.col("list_label"))
    return F.concat(F.when(label != "", F.concat(label, F.lit(" "))).otherwise(F.lit("")), strip(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))))


def structure_plan(elements: DataFrame, alts: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """The plan of all rendered elements, in one pass: what each is tagged as, where it lies and what is written there.

    (doc_id, pos, role, page_index, y, block_count, lines, text_preview, cells,
    n_rows, row_sizes, n_headers, list_label, alt_text, decorative, href, k).
    cells has a table's rows, row_sizes the cells of each. Text is laid out as
    it is written: stripped, and behind its label in a list. alts (doc_id, pos,
    alt) are alternative texts to show; without it images show their own.
    """
    kept = content(elements)
    kept = kept.join(alts.select("doc_id", "pos", "alt"), ["doc_id", "pos"], "left") if alts is not None else kept.withColumn("alt", F.when(F.col("type") == "image", F.when(F.col("decorative"), F.lit("")).otherwise(cleaned(F.col("alt_text")))))
    href = F.col("href") if "href" in elements.columns else F.lit(None).cast("string")
    rows = kept.select("doc_id", "pos", "type", "heading_level", F.substring(F.coalesce("text", F.lit("")), 1, 80).alias("text_preview"), _shown().alias("text"), _cells().alias("cells"), "alt", "alt_text", "decorative", "n_headers", list_label(F.col("list_label")).alias("list_label"), href.alias("href"), "k")
    made = laid_out(rows, parts).withColumn("row_sizes", F.transform("cells", F.size))
    return made.select("doc_id", "pos", role().alias("role"), "page_index", "y", "block_count", "lines", "text_preview", "cells", F.size("cells").cast("long").alias("n_rows"), "row_sizes", "n_headers", "list_label", "alt", "alt_text", "decorative", "href", "k")


def failed(plan: DataFrame, why: str) -> DataFrame:
    """One row for each document of a plan that could not be written."""
    return plan.select("doc_id").distinct().select("doc_id", F.lit("failed").alias("status"), F.lit(why).alias("details"))


FALLBACK_TITLE, FALLBACK_LANGUAGE = "Accessible Document", "en-AU"  # fixed values


def document_values(documents: DataFrame, values: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, title, language): the accepted value, else the document's own, else its first text and a fixed language.

    values: (doc_id, action, value); texts: (doc_id, first_text).
    """
    of = lambda action: F.max(F.when(F.col("action") == action, F.col("value")))
    accepted = values.groupBy("doc_id").agg(of("set_document_title").alias("t"), of("set_document_language").alias("l"))
    rows = documents.select("doc_id", "title", "language").join(accepted, "doc_id", "left").join(texts, "doc_id", "left")
    title = F.coalesce(cleaned(F.col("t")), F.nullif("title", F.lit("")), "first_text", F.lit(FALLBACK_TITLE))
    return rows.select("doc_id", title.alias("title"), F.coalesce(cleaned(F.col("l")), F.nullif("language", F.lit("")), F.lit(FALLBACK_LANGUAGE)).alias("language"))


BOX = ["x0", "y0", "x1", "y1"]


def alt_texts(elements: DataFrame, accepted: DataFrame) -> DataFrame:
    """(doc_id, pos, alt) of images: empty for decorative ones, else the latest accepted text for the element, else its own.

    accepted: (doc_id, seq, element_id, page_number, x0, y0, x1, y1, value) of
    accepted alternative texts with their issue's place. It is an element's by
    id; or by page, where the issue's box is the element's or is not known;
    or, without a page, by the whole place. Each way is a key of its own, and one equi-join meets them all.
    """
    page, boxed = F.col("page_number"), [F.col(c) for c in BOX]
    key = lambda way, *have: F.struct(F.lit(way).alias("way"), *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in [("element_id", "string"), ("page_number", "long"), *[(c, "double") for c in BOX]]])
    by_id, by_box, by_page, by_place = key(1, "element_id"), key(2, "page_number", *BOX), key(3, "page_number"), key(4, "element_id", "page_number", *BOX)
    known = lambda cols: F.forall(F.array(*cols), lambda x: x.isNotNull())
    listed = lambda *ways: F.filter(F.array(*[F.when(when, k) for when, k in ways]), lambda x: x.isNotNull())
    named, on_page, nowhere = (F.col("element_id") != "", by_id), page != 0, (F.coalesce(page, F.lit(0)) == 0, by_place)
    given = accepted.withColumn("value", cleaned(F.col("value"))).filter("value is not null")
    given = given.select("doc_id", "seq", "value", F.explode(listed(named, (on_page & known(boxed), by_box), (on_page & F.col("x0").isNull(), by_page), nowhere)).alias("key"))
    given = given.groupBy("doc_id", "key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    images = elements.filter("type = 'image'").select("doc_id", "pos", "alt_text", "decorative", F.explode_outer(listed(named, (on_page & known(boxed), by_box), (on_page, by_page), nowhere)).alias("key"))
    latest = images.join(given, ["doc_id", "key"], "left").groupBy("doc_id", "pos", "alt_text", "decorative").agg(F.max_by("value", "seq").alias("value"))
    own = F.coalesce("value", cleaned(F.col("alt_text")))
    return latest.select("doc_id", "pos", F.when(F.col("decorative"), F.lit("")).otherwise(own).alias("alt"))


def role_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("doc_id", "role").agg(F.count(F.lit(1)).cast("long").alias("n"))
