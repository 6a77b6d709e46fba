"""Tag trees from the plan.

A tree is a flat table of nodes: (doc_id, pos, row, cell, role, page_index,
is_top, is_leaf, mcid, alt, scope, struct_parent, k). Lists have pos of their
first item. The checks are in validation.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import validation


def islands(plan: DataFrame) -> DataFrame:
    """Each plan row's island: list items next to each other on one page share one, other rows stand alone."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return plan.withColumn("island", F.sum(F.when(_joins(), 0).otherwise(1)).over(w).cast("long"))


def _joins() -> Column:
    """Whether a plan row is a list item next to another one on its page."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    return F.coalesce((F.col("role") == "LI") & (F.lag("role").over(w) == "LI") & (F.lag("page_index").over(w) == F.col("page_index")), F.lit(False))


def nodes(plan: DataFrame, keep_plan: bool = False) -> DataFrame:
    """All nodes of the tree, with content ids counted on each page in order over leaves.

    keep_plan also keeps the plan's rows, told apart by kind ('plan' or 'node').
    Links carry their annotation's struct_parent where the plan has it. Header
    cells have the scope Column.
    """
    whole = F.when(F.col("role") == "Table", F.aggregate("row_sizes", F.lit(0).cast("long"), lambda a, n: a + n)).otherwise(1)
    before = F.sum("leaves").over(Window.partitionBy("doc_id", "page_index").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("leaves")
    at = plan.withColumn("leaves", whole).withColumn("before", before).withColumn("first", ~_joins())
    made = lambda kind, row, cell, role, top, leaf: F.struct(F.lit(kind).alias("kind"), row.cast("long").alias("row"), cell.cast("long").alias("cell"), role.alias("role"), F.lit(top).alias("is_top"), F.lit(leaf).alias("is_leaf"))
    node = lambda *x: made(validation.NODE, *x)
    none = F.lit(-1)
    listed = F.filter(F.array(F.when(F.col("first"), node(F.lit(-2), none, F.lit("L"), True, False)), node(none, none, F.lit("LI"), False, False), node(F.lit(0), F.lit(0), F.lit("Lbl"), False, False), node(F.lit(0), F.lit(1), F.lit("LBody"), False, True)), lambda x: x.isNotNull())
    th = lambda r: F.when((r == 0) & (F.col("n_headers") > 0), F.lit("TH")).otherwise(F.lit("TD"))
    cells = F.flatten(F.transform("row_sizes", lambda n, r: F.concat(F.array(node(r, none, F.lit("TR"), False, False)), F.transform(F.sequence(F.lit(0), n - 1), lambda c: node(r, c, th(r), False, True)))))
    table = F.concat(F.array(node(none, none, F.lit("Table"), True, False)), cells)
    single = F.array(node(none, none, F.col("role"), True, True))
    every = F.when(F.col("role") == "LI", listed).when(F.col("role") == "Table", table).otherwise(single)
    if keep_plan:
        every = F.concat(every, F.array(made(validation.PLAN, none, none, F.col("role"), False, False)))
    rows = at.select("*", F.posexplode(every).alias("nth", "n"))
    alt = F.when(F.col("n.role") == "Figure", F.when(F.col("decorative"), F.lit("")).otherwise(F.col("alt_text")))
    more = ["kind", "row_sizes", "n_headers"] if keep_plan else []
    parent = F.col("struct_parent") if "struct_parent" in plan.columns else F.lit(None).cast("long")
    own = F.when(F.col("role") == "Table", F.col("nth") - F.col("n.row") - 2).otherwise(0)  # leaves before it in its element: a table and its rows come before their cells
    rows = rows.select("doc_id", "pos", "n.row", "n.cell", "n.role", "page_index", "n.is_top", "n.is_leaf", alt.alias("alt"), F.when(F.col("n.role") == "TH", "Column").alias("scope"), F.when(F.col("n.role") == "Link", parent).alias("struct_parent"), *[f"n.{c}" if c == "kind" else c for c in more], "k", F.when(F.col("n.is_leaf"), F.col("before") + own).cast("long").alias("mcid"))
    return rows


def damage(tree: DataFrame) -> DataFrame:
    """A tree with known faults, for the checks: lost alt texts, shifted ids, and nodes that are gone (list bodies and items, header cells, other whole elements)."""
    k, role = F.col("k"), F.col("role")
    listed = role.isin("LI", "Lbl", "LBody")
    gone = ((role == "LBody") & (k % 11 == 0)) | ((role == "TH") & (k % 13 == 0)) | (listed & (k % 23 == 0)) | (~listed & (role != "L") & (k % 19 == 0))
    rows = tree.withColumn("alt", F.when(k % 7 != 0, F.col("alt"))).withColumn("gone", gone)
    return rows.withColumn("mcid", F.when((k % 17 == 0) & F.col("is_leaf"), F.lit(0)).otherwise(F.col("mcid")).cast("long"))


def damaged(tree: DataFrame) -> DataFrame:
    """What is left of a tree after damage."""
    return damage(tree).filter("not gone").drop("gone")


def with_struct_parents(plan: DataFrame) -> DataFrame:
    """plan with the parent-tree key of each link's annotation: the pages' annotations go to its links in order, first in first out.

    Annotations are those of links whose k is not divisible by 5; their keys
    follow the pages'. Null for links that get none and for other rows. Windows
    within a document alone.
    """
    link = F.col("role") == "Link"
    note = link & (F.col("k") % 5 != 0)
    doc, page = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "page_index")
    ahead = Window.partitionBy("doc_id").orderBy("page_index").rangeBetween(Window.unboundedPreceding, -1)
    nth = F.count_if(link).over(page.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    rows = plan.withColumn("ord", nth).withColumn("here", F.count_if(note).over(page)).withColumn("ahead", F.count_if(note).over(ahead)).withColumn("pages", F.max("page_index").over(doc) + 1)  # one sort for all
    key = F.when(link & (F.col("ord") <= F.col("here")), F.col("pages") + F.col("ahead") + F.col("ord") - 1)
    return rows.withColumn("struct_parent", key.cast("long")).withColumn("ord", F.when(link, F.col("ord"))).drop("pages", "here", "ahead")


def zipped_links(plan: DataFrame) -> DataFrame:
    """Links of the plan with the annotations of their page, by order; null where there are fewer annotations."""
    return with_struct_parents(plan).filter("role = 'Link'").select("doc_id", "pos", "page_index", "ord", "struct_parent")


def parent_tree(tree: DataFrame) -> DataFrame:
    """(doc_id, key, entries): a list of leaves for each page, one entry for each annotation of a link."""
    own = F.array(F.when(F.col("is_leaf"), F.col("page_index")), F.when(F.col("role") == "Link", F.col("struct_parent")))
    rows = tree.select("doc_id", F.explode(F.filter(own, lambda x: x.isNotNull())).alias("key"))
    return rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).cast("long").alias("entries"))


def parent_tree_nodes(tree: DataFrame) -> DataFrame:
    """(doc_id, key, nodes): the parent tree's entries, those of a page in the order of their content ids, that of an annotation its link.

    nodes is an array of (mcid, pos, row, cell, role); mcid is -1 for annotations.
    """
    node = lambda i: F.struct(i.alias("mcid"), "pos", "row", "cell", "role")
    own = F.array(F.when(F.col("is_leaf"), F.struct(F.col("page_index").alias("key"), node(F.col("mcid")).alias("n"))), F.when((F.col("role") == "Link") & F.col("struct_parent").isNotNull(), F.struct(F.col("struct_parent").alias("key"), node(F.lit(-1).cast("long")).alias("n"))))
    rows = tree.select("doc_id", F.explode(F.filter(own, lambda x: x.isNotNull())).alias("e"))
    return rows.groupBy("doc_id", F.col("e.key").alias("key")).agg(F.sort_array(F.collect_list("e.n")).alias("nodes"))


def tagged_records(plan: DataFrame, hurt=None, lost_keys=None) -> DataFrame:
    """Records for validation of the tree that is made of a plan: plan, tree, parent tree and marks from one pass over it.

    hurt(tree) is the tree with its faults, rows that are lost being gone; lost_keys(key)
    says which keys the parent tree lacks. Without them the tree is as it was made.
    """
    tree = nodes(with_struct_parents(plan), keep_plan=True)
    if hurt is not None:
        tree = hurt(tree)
    gone = F.col("gone") if "gone" in tree.columns else F.lit(False)
    planned, node = F.col("kind") == validation.PLAN, F.col("kind") == validation.NODE
    kept = node & ~gone
    lost = lambda key: F.coalesce(lost_keys(key), F.lit(False)) if lost_keys is not None else F.lit(False)
    page, link = F.col("page_index"), node & (F.col("role") == "Link") & F.col("struct_parent").isNotNull()
    made = {
        "kind": F.when(node & gone, validation.GONE).otherwise(F.col("kind")), "alt": F.when(~planned, F.col("alt")), "struct_parent": F.when(~planned, F.col("struct_parent")), "mcid": F.when(~planned, F.col("mcid")), "n": F.lit(None),
        "row_sizes": F.when(planned, F.col("row_sizes")), "n_headers": F.when(planned, F.col("n_headers")),
        "entries": F.when(kept & F.col("is_leaf") & ~lost(page), 1), "link_entries": F.when(link & ~lost(F.col("struct_parent")), 1), "marks": F.when(node & F.col("is_leaf"), 1),
    }
    return tree.select("doc_id", *[made.get(c, F.col(c)).cast(t).alias(c) for c, t in validation.RECORD.items()])


def top_roles(plan: DataFrame) -> DataFrame:
    """(doc_id, ord, value): the roles that a plan puts at the top level, in order; list items next to each other are one list."""
    rows = islands(plan).groupBy("doc_id", "island").agg(F.min_by("role", "pos").alias("role"))
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("island")).cast("long").alias("ord"), F.when(F.col("role") == "LI", "L").otherwise(F.col("role")).alias("value"))


def root_present(pdf: DataFrame) -> DataFrame:
    return pdf.select("doc_id", F.coalesce("has_struct_tree", F.lit(False)).alias("passed"))


def marked(pdf: DataFrame) -> DataFrame:
    return pdf.select("doc_id", F.coalesce("mark_info_marked", F.lit(False)).alias("passed"))
