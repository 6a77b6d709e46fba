"""Document fingerprints: Merkle trees over the paragraphs and sections of texts.

The leaves are the clauses of a paragraph (a line): stretches up to a mark of
punctuation. A paragraph's digest is that of its leaves' digests, a section's
that of its paragraphs', the root that of its sections'. A section ends behind
an empty paragraph and behind one of eight others, as their own digests say, so
an edit moves no section's end but near itself.

A fingerprint is text: root/sections/paragraphs/leaves, each level a list in
order: sections as digest:paragraphs, paragraphs as digest:leaves:characters,
leaves as digest:characters. Equal roots mean equal texts; where roots differ,
the branches that differ hold the edits. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import by_row, materialize

#: A clause: characters up to marks and the blanks behind them, or what is left at a paragraph's end.
MARKS = ".!?;:,。！？；：，、"
CLAUSE = f"[^{MARKS}]*[{MARKS}]+[ \t]*|[^{MARKS}]+"
#: Hexadecimal digits that a fingerprint keeps of a leaf's, and of a paragraph's and section's digest. The root has all.
LEAF, BRANCH = 10, 16


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once for all of its uses inside functions of elements."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def tree(text: Column) -> Column:
    """Paragraphs in order: (sha, leaves array of (sha, chars)) of a text."""
    leaf = lambda x: F.struct(F.sha2(x, 256).alias("sha"), F.length(x).alias("chars"))
    leaves = F.transform(F.split(text, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(CLAUSE), F.lit(0)), leaf))
    return F.transform(leaves, lambda x: F.struct(digest(x["sha"]).alias("sha"), x.alias("leaves")))


def section_ends(paragraphs: Column) -> Column:
    """Numbers (from 1) of the paragraphs that end a section: empty ones, those whose digest begins with 0 or 1, the last."""
    last = F.size(paragraphs)
    closes = lambda p: (F.size(p["leaves"]) == 0) | F.substring(p["sha"], 1, 1).isin("0", "1")
    numbered = F.transform(paragraphs, lambda p, i: F.when(closes(p) | (i + 1 == last), i + 1))
    return F.filter(numbered, lambda n: n.isNotNull())


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; a null text counts as an empty one."""

    def level(items: Column, name: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(items, name), " ")

    def shown(paragraphs: Column, ends: Column) -> Column:
        sections = F.transform(ends, lambda e, i: let(e - F.when(i > 0, F.get(ends, i - 1)).otherwise(0), lambda n: F.struct(digest(F.transform(F.slice(paragraphs, e - n + 1, n), lambda p: p["sha"])).alias("sha"), n.alias("n"))))
        named = lambda digits, x, *n: F.concat_ws(":", F.substring(x, 1, digits), *[c.cast("string") for c in n])
        chars = lambda leaves: F.aggregate(leaves, F.lit(0), lambda sofar, x: sofar + x["chars"])
        return let(
            sections,
            lambda s: F.concat_ws(
                "/", digest(F.transform(s, lambda x: x["sha"])), level(s, lambda x: named(BRANCH, x["sha"], x["n"])), level(paragraphs, lambda p: named(BRANCH, p["sha"], F.size(p["leaves"]), chars(p["leaves"]))),
                level(F.flatten(F.transform(paragraphs, lambda p: p["leaves"])), lambda x: named(LEAF, x["sha"], x["chars"])),
            ),
        )

    return let(tree(F.coalesce(text, F.lit(""))), lambda p: let(section_ends(p), lambda e: shown(p, e)))


def parts(print_: Column, level: int) -> Column:
    """The list of a fingerprint's level: 1 sections, 2 paragraphs, 3 leaves."""
    return F.filter(F.split(F.get(F.split(print_, "/"), F.lit(level)), " "), lambda x: x != "")


def weight(items: Column) -> Column:
    """Characters of leaves."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda sofar, x: sofar + F.substring_index(x, ":", -1).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """1 where roots are equal; else the characters of the different leaves that both have, twice, of the characters of the different leaves of each."""
    each = F.struct(F.array_distinct(parts(a, 3)).alias("a"), F.array_distinct(parts(b, 3)).alias("b"))
    shared = let(each, lambda x: let(weight(x["a"]) + weight(x["b"]), lambda both: F.when(both > 0, 2.0 * weight(F.array_intersect(x["a"], x["b"])) / both).otherwise(0.0)))
    return F.when(F.substring_index(a, "/", 1) == F.substring_index(b, "/", 1), 1.0).otherwise(shared)


def edits(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, paragraph, start, chars): the paragraphs of a's text, from 0, that b's has not, with the characters they take.

    a and b are columns of fingerprints, key is unique. Found from the
    fingerprints alone: sections that both have are passed over whole, as are
    paragraphs that both have. Rows with a null fingerprint or equal roots give none.
    """
    from pyspark.sql import Window

    number = lambda x, k: F.get(F.split(x, ":"), F.lit(k)).cast("long")
    differ = rows.filter(F.substring_index(a, "/", 1) != F.substring_index(b, "/", 1))
    within = F.flatten(F.transform(parts(F.col(a), 1), lambda s: F.array_repeat(s, number(s, 1).cast("int"))))
    own = differ.select(key, F.posexplode(F.arrays_zip(parts(F.col(a), 2).alias("p"), within.alias("s"))).alias("paragraph", "x"))
    placed = own.select(key, "paragraph", "x.*", number(F.col("x.p"), 2).alias("chars"))
    placed = placed.withColumn("start", F.sum(F.col("chars") + 1).over(Window.partitionBy(key).orderBy("paragraph")) - F.col("chars") - 1)
    theirs = lambda level, name: differ.select(key, F.explode(F.array_distinct(parts(F.col(b), level))).alias(name))
    return placed.join(theirs(1, "s"), [key, "s"], "left_anti").join(theirs(2, "p"), [key, "p"], "left_anti").select(key, "paragraph", "start", "chars")


def following(keys: DataFrame) -> DataFrame:
    """(row_key, next_key): the next smaller key of different ones, of the smallest the largest.

    Keys are dealt by range and each range is ordered by itself; what follows
    its last key is the first of the next range, of which there are as many as
    partitions (spark.sql.shuffle.partitions), so that table is broadcast.
    """
    from pyspark.sql import Window

    dealt = materialize(keys.select("row_key").repartitionByRange("row_key").withColumn("part", F.spark_partition_id()), "ranges")
    firsts = dealt.groupBy("part").agg(F.max("row_key").alias("first"))
    whole = Window.partitionBy(F.lit(0)).orderBy("part")
    top = F.max("first").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("part", F.coalesce(F.lag("first").over(whole), top).alias("below"))
    inside = F.lead("row_key").over(Window.partitionBy("part").orderBy(F.desc("row_key")))
    return dealt.withColumn("inside", inside).join(F.broadcast(firsts), "part").select("row_key", F.coalesce("inside", "below").alias("next_key"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third (rounded down) replaced by as many first
    characters of the next document, by descending doc_id and after the last
    the first; all of them where it is shorter. Null texts are empty. Rows that
    repeat an id follow each other by text, rows with null ids come before all
    others; a single row follows itself. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = by_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    texts = rows.select("row_key", "text")  # in both joins the same columns, so that texts are shuffled once
    third = lambda t: F.floor(F.length(t) / 3).cast("int")
    wanted = following(texts).join(rows.select("row_key", "doc_id", third(F.col("text")).alias("third")), "row_key").select(F.col("row_key").alias("of"), "doc_id", "next_key", "third")
    next_ = texts.hint("merge").join(wanted, F.col("row_key") == F.col("next_key")).select("of", "doc_id", F.substring("text", F.lit(1), F.col("third")).alias("head"), fingerprint(F.col("text")).alias("next_print"))
    both = texts.hint("merge").join(next_, F.col("row_key") == F.col("of"))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third(F.col("text"))), F.col("head"))
    made = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(edited).alias("edited_fingerprint"), "next_print")
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_print").alias("near_next"))
