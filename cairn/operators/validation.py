"""Structural validation: a tag tree held against its plan, pages and parent tree, all checks in one pass.

What is known of a document comes as records of one shape (see RECORD), dealt
by doc_id once; every window and aggregate after that is within that dealing.
Records become facts, facts are summed up by their keys, those by what they
belong to (an ordinal, a page, a table, a list), and those by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of records: an element of the plan, a node of the tree, an entry of the parent tree, marks of a page's stream, a node that is gone.
PLAN, NODE, PARENT, MARKS, GONE = "plan", "node", "parent", "marks", "gone"
#: Plan: pos, role, page_index, row_sizes, n_headers. Node: pos, row, cell, role, page_index, is_top, is_leaf, mcid, alt,
#: struct_parent (of a link's annotation). Parent: page_index (the key), n (entries). Marks: page_index, n.
#: Nodes, gone ones too, may also bring the parent tree's entries under their page and struct_parent (entries, link_entries) and their page's marks.
RECORD = {
    "kind": "string", "pos": "long", "row": "long", "cell": "long", "role": "string", "page_index": "long", "is_top": "boolean", "is_leaf": "boolean",
    "mcid": "long", "alt": "string", "struct_parent": "long", "n": "long", "row_sizes": "array<int>", "n_headers": "long",
    "entries": "long", "link_entries": "long", "marks": "long",
}
#: Facts: a place at the top or of a leaf, a role, a node inside its element, a page or other key of the parent tree; roles that are counted.
TOP, LEAF, ROLE, INNER, PAGE = range(5)
CODES = ["Table", "TR", "TH", "TD", "L", "LI", "Lbl", "LBody", "Figure", "Link"]
#: The checks in order; the last one needs a plan.
CHECKS = [
    "structure.root_present", "structure.mark_info_marked", "structure.mcid_parent_tree", "structure.figures_have_alt", "structure.links_reference_annotations", "structure.link_annotations_mapped",
    "structure.tables_have_roles", "structure.lists_have_roles", "structure.reading_order_matches_plan", "structure.matches_plan",
]


def record(kind: str, **given: Column) -> Column:
    """A record as a struct; what is not given is null."""
    return F.struct(*[(F.lit(kind) if c == "kind" else given.get(c, F.lit(None))).cast(t).alias(c) for c, t in RECORD.items()])


def records(plan: DataFrame | None, tree: DataFrame, parents: DataFrame, marks: DataFrame) -> DataFrame:
    """Records of separate tables; columns of a record that a table lacks are null."""
    tables = [(PLAN, plan), (NODE, tree), (PARENT, parents), (MARKS, marks)]
    rows = [t.select("doc_id", record(k, **{c: F.col(c) for c in RECORD if c in t.columns}).alias("r")) for k, t in tables if t is not None]
    return reduce(DataFrame.unionByName, rows).select("doc_id", "r.*")


def evaluated(found: DataFrame) -> DataFrame:
    """One row per document with records: what each check has counted against it, and how much there is of everything.

    Facts carry numbers alone beside their keys, so they are summed up by
    hashing; places in an order are running counts of the one sort by place.
    Two orders are alike in as many places as have one value on both sides.
    """
    whole = Window.partitionBy("doc_id", "kind").orderBy("pos", "row", "cell")
    upto = whole.rowsBetween(Window.unboundedPreceding, 0)
    role, page, cell = F.col("role"), F.col("page_index"), F.col("cell")
    planned, node = F.col("kind") == PLAN, F.col("kind") == NODE
    on_page = Window.partitionBy("doc_id", "kind", "is_leaf", "page_index").orderBy("pos", "row", "cell")
    rows = found.withColumn("before", F.lag("mcid").over(on_page))
    joins = (role == "LI") & (F.lag("role").over(whole) == "LI") & (F.lag("page_index").over(whole) == page)
    rows = rows.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("head", F.last(F.when(F.col("is_top"), F.col("pos")), ignorenulls=True).over(upto))
    sizes = F.coalesce("row_sizes", F.array().cast("array<int>"))
    is_table = planned & (role == "Table")
    leaves = F.when(is_table, F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + F.greatest(n, F.lit(0)))).when(planned | (node & F.col("is_leaf")), 1).otherwise(0)
    rows = rows.withColumn("top", F.when(planned, ~F.col("joins")).otherwise(node & F.coalesce("is_top", F.lit(False)))).withColumn("leaves", leaves)
    rows = rows.withColumn("nth_top", F.count_if("top").over(upto)).withColumn("nth_leaf", F.sum("leaves").over(upto) - F.col("leaves") + 1)

    kinds = {"fact": "int", "k1": "long", "k2": "long", "key": "string", "want": "int", "got": "int", "late": "int", "entries": "long", "marks": "long", "links": "int", "code": "int", "flag": "int", "inner": "int"}

    def fact(which: int, when: Column, **given) -> Column:
        given["fact"] = which
        return F.when(when, F.struct(*[(v if isinstance(v := given.get(c), Column) else F.lit(v)).cast(t).alias(c) for c, t in kinds.items()]))

    at = lambda r: F.concat_ws("@", r, page)
    side = {"want": planned.cast("int"), "got": node.cast("int")}
    headed = F.coalesce(F.col("n_headers"), F.lit(0)) > 0
    cells = F.flatten(F.transform(sizes, lambda n, r: F.array_repeat(F.when((r == 0) & headed, at(F.lit("TH"))).otherwise(at(F.lit("TD"))), n)))
    listed = F.coalesce(role.isin("LI", "Lbl", "LBody"), F.lit(False))
    code = F.coalesce(reduce(lambda c, x: c.when(role == x[1], x[0] + 1), enumerate(CODES[1:], 1), F.when(role == CODES[0], 1)), F.lit(0))
    rows = rows.withColumn("code", code)
    flag = F.when((role == "Figure") & F.col("alt").isNull(), 1).when((role == "Link") & F.col("struct_parent").isNull(), 2)
    told = {"code": F.when(node, F.col("code")), "flag": F.when(node, flag)}
    alone = F.col("top") & F.col("code").isin(0, CODES.index("Figure") + 1, CODES.index("Link") + 1) & ~F.coalesce(cell >= 0, F.lit(False))  # of a node that nothing lies in
    late = F.col("mcid").isNull() | page.isNull() | F.coalesce(F.col("mcid") <= F.col("before"), F.lit(False))
    entries, marks = F.when(F.col("kind") == PARENT, F.col("n")).otherwise(F.col("entries")), F.when(F.col("kind") == MARKS, F.col("n")).otherwise(F.col("marks"))
    linked = node & (role == "Link")
    own = F.array(
        fact(TOP, F.col("top"), k1=F.col("nth_top"), key=F.when(planned & (role == "LI"), "L").otherwise(role), **side, **{c: F.when(alone, v) for c, v in told.items()}),
        fact(LEAF, (planned & ~is_table) | (node & F.col("is_leaf")), k1=F.col("nth_leaf"), key=at(F.when(planned & (role == "LI"), "LBody").otherwise(role)), **side, late=F.when(node, late.cast("int"))),
        fact(ROLE, planned | (node & (F.col("top") | listed)), key=role, **side),
        fact(INNER, node & ~alone, k1=F.col("head"), k2=F.when(listed, F.col("pos")).otherwise(F.col("row")), **told, inner=(cell >= 0).cast("int")),
        fact(PAGE, F.col("kind").isin(PARENT, MARKS) | entries.isNotNull() | marks.isNotNull(), k1=page, entries=entries, marks=marks),
        fact(PAGE, F.col("struct_parent").isNotNull() & (linked | F.col("link_entries").isNotNull()), k1=F.col("struct_parent"), entries=F.col("link_entries"), links=linked.cast("int")),
    )
    tabled = F.transform(cells, lambda v, i: fact(LEAF, F.lit(True), k1=F.col("nth_leaf") + i, key=v, want=1, got=0))
    every = rows.select("doc_id", own.alias("own"), F.when(is_table, tabled).alias("tabled"))
    facts = every.select("doc_id", F.explode(F.when(F.col("tabled").isNull(), F.col("own")).otherwise(F.concat("own", "tabled"))).alias("f")).filter("f is not null").select("doc_id", "f.*")

    one = facts.groupBy("doc_id", "fact", "k1", "k2", "key").agg(
        *[F.sum(c).alias(c) for c in ("want", "got", "late", "entries", "marks", "links")], F.count("code").alias("all"), F.count_if(F.col("flag") == 1).alias("no_alt"), F.count_if(F.col("flag") == 2).alias("no_ref"),
        *[F.count_if(F.col("code") == k).alias(x) for k, x in enumerate(CODES, 1)], F.count_if((F.col("inner") == 1) & ~F.col("code").isin(CODES.index("TH") + 1, CODES.index("TD") + 1)).alias("other"),
    )
    is_ = lambda which: F.col("fact") == which
    row_fails = (F.col("TR") > 0) & ((F.col("TH") + F.col("TD") == 0) | (F.col("other") > 0))
    item_fails = (F.col("LI") > 0) & ((F.col("Lbl") == 0) | (F.col("LBody") == 0))
    marks, alike = F.coalesce("marks", F.lit(0)), (F.col("want") == 1) & (F.col("got") == 1)
    unmapped = F.when(is_(PAGE) & F.col("k1").isNotNull() & F.col("entries").isNull(), F.col("links"))
    many = lambda when: F.count_if(when)
    two = one.groupBy("doc_id", is_(INNER).alias("inner"), F.when(is_(INNER), F.col("k1")).alias("head")).agg(
        *[F.sum(c).alias(c) for c in ("all", "late", "no_alt", "no_ref", "Table", "TR", "TH", "TD", "L", "LI", "Figure", "Link", "entries", "marks")], many(row_fails).alias("rows_fail"), many(item_fails).alias("items_fail"),
        *[F.sum(F.when(is_(k), F.col(c))).alias(f"{name}_{c}") for k, name in ((TOP, "top"), (LEAF, "leaf")) for c in ("want", "got")], *[many(is_(k) & alike).alias(f"{name}_alike") for k, name in ((TOP, "top"), (LEAF, "leaf"))],
        many(is_(ROLE) & (F.col("got") < F.col("want"))).alias("roles_short"), F.sum(unmapped).alias("unmapped"),
        many(is_(PAGE) & (marks > 0) & (F.coalesce("entries", F.lit(0)) < marks)).alias("pages_short"), many(is_(PAGE) & (marks > 0) & F.col("entries").isNull()).alias("pages_without_key"),
    )
    table_fails = (F.col("Table") > 0) & ((F.col("TR") == 0) | (F.col("rows_fail") > 0) | (F.col("TH") == 0) | (F.col("TD") == 0))
    list_fails = (F.col("L") > 0) & ((F.col("LI") == 0) | (F.col("items_fail") > 0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    unlike = lambda name: (F.greatest(total(f"{name}_want"), total(f"{name}_got")) - total(f"{name}_alike")).cast("long")
    inside = lambda when: F.count_if(F.col("inner") & when).cast("long")
    return two.groupBy("doc_id").agg(
        total("pages_short").alias("pages_short"), total("pages_without_key").alias("pages_without_key"), total("no_alt").alias("figures_without_alt"), total("no_ref").alias("links_without_annotation"),
        total("unmapped").alias("annotations_unmapped"), inside(table_fails).alias("tables_wrong"), inside(list_fails).alias("lists_wrong"),
        unlike("top").alias("tops_wrong"), unlike("leaf").alias("leaves_wrong"), total("late").alias("ids_wrong"),
        total("roles_short").alias("roles_short"), total("top_want").alias("tops_planned"), total("leaf_want").alias("leaves_planned"), total("top_got").alias("tops"),
        total("all").alias("nodes"), total("marks").alias("marks"), total("entries").alias("entries"), *[total(c).alias(n) for c, n in (("Figure", "figures"), ("Link", "links"), ("Table", "tables"), ("L", "lists"))],
    )


COUNTS = ["marks", "entries", "nodes", "tops", "figures", "links", "tables", "lists"]


def validate(documents: DataFrame, found: DataFrame, planned: bool = True) -> DataFrame:
    """One row for each document (doc_id, has_struct_tree, mark_info_marked), without records too.

    checks is an array of (check_id, passed, failures) in the order of CHECKS,
    reading_order a struct of its four parts; then status, check_count,
    passed_count, failed_count and COUNTS. A document without a plan's records
    has no order to be held to. planned=False leaves the last check out.
    """
    rows = documents.select("doc_id", "has_struct_tree", "mark_info_marked").join(evaluated(found), "doc_id", "left").fillna(0)
    c = F.col
    order_parts = {"top_level_order": F.when(c("tops_planned") == 0, 0).otherwise(c("tops_wrong")), "content_sequence": F.when(c("leaves_planned") == 0, 0).otherwise(c("leaves_wrong")), "ids_increase": c("ids_wrong"), "keys_match_pages": c("pages_without_key")}
    absent = lambda flag: F.when(F.coalesce(c(flag), F.lit(False)), 0).otherwise(1)
    failures = [
        absent("has_struct_tree"), absent("mark_info_marked"), c("pages_short"), c("figures_without_alt"), c("links_without_annotation"), c("annotations_unmapped"), c("tables_wrong"), c("lists_wrong"),
        reduce(lambda a, b: a + b, order_parts.values()), c("roles_short") + F.greatest(F.lit(0), c("tops_planned") - c("tops")),
    ]
    check = lambda name, n: F.struct(F.lit(name).alias("check_id"), (n == 0).alias("passed"), n.cast("long").alias("failures"))
    made = rows.withColumn("checks", F.array(*[check(name, n) for name, n in list(zip(CHECKS, failures, strict=True))[: len(CHECKS) - (not planned)]]))
    failed = F.size(F.filter("checks", lambda x: ~x["passed"]))
    made = made.withColumn("failed_count", failed.cast("long"))
    return made.select(
        "doc_id", "checks", F.struct(*[(n == 0).alias(k) for k, n in order_parts.items()]).alias("reading_order"), F.when(c("failed_count") == 0, "passed").otherwise("failed").alias("status"),
        F.size("checks").cast("long").alias("check_count"), (F.size("checks") - c("failed_count")).cast("long").alias("passed_count"), "failed_count", *COUNTS,
    )


def check_rows(validated: DataFrame) -> DataFrame:
    """(doc_id, check_id, status, passed, failures): a row for each check of each document."""
    rows = validated.select("doc_id", F.explode("checks").alias("c")).select("doc_id", "c.*")
    return rows.select("doc_id", "check_id", F.when(F.col("passed"), "passed").otherwise("failed").alias("status"), "passed", "failures")


def check(validated: DataFrame, check_id: str) -> DataFrame:
    """(doc_id, passed) of one check."""
    return validated.select("doc_id", F.get("checks", F.lit(CHECKS.index(check_id)))["passed"].alias("passed"))


def role_counts(found: DataFrame) -> DataFrame:
    """(doc_id, role, n) of the trees in records."""
    return found.filter(F.col("kind") == NODE).groupBy("doc_id", "role").agg(F.count(F.lit(1)).cast("long").alias("n"))
