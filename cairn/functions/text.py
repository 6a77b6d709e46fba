"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space that stripping removes: that of ASCII, the separators of information, and Unicode's.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(c, F.lit(SPACE))


def cleaned(c: Column) -> Column:
    """Stripped text, or null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def folded(c: Column) -> Column:
    """For comparing without case: lower case after upper, so that letters with several lower forms meet."""
    return F.lower(F.upper(c))


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def output_name(name: Column) -> Column:
    """Stem with all but letters, digits, - and _ replaced, and the suffix of rebuilt files."""
    return F.concat(F.regexp_replace(stem(name), r"[^\p{L}\p{N}_-]", "_"), F.lit("_accessible.pdf"))


def escaped(c: Column) -> Column:
    """Backslash and parentheses escaped, as PDF strings need it."""
    return F.regexp_replace(c, r"([\\()])", r"\\$1")


def fit_cell(c: Column) -> Column:
    flat = strip(F.replace(c, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(flat) <= 28, flat).otherwise(F.concat(F.substring(flat, 1, 25), F.lit("...")))


def parse_row(line: Column) -> Column:
    """Cells of a table line: by tabs, else pipes, else commas, else two white spaces or more; blank cells are dropped."""
    bare = strip(line)
    outer = F.regexp_replace(bare, r"^\|+|\|+$", "")
    cells = F.when(bare.contains("\t"), F.split(bare, "\t")).when(bare.contains("|"), F.split(outer, r"\|")).when(bare.contains(","), F.split(bare, ",")).otherwise(F.split(bare, r"(?U)\s{2,}"))
    return F.filter(F.transform(cells, strip), lambda x: x != "")


def lines_of(c: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip), lambda x: x != "")


def table_rows(c: Column, headers: Column) -> Column:
    """Rows of a table's text, under its headers unless the first row is the same but for case."""

    def joined(p: Column) -> Column:
        rows, named = p["rows"], p["named"]
        same = F.coalesce(F.transform(F.get(rows, F.lit(0)), folded) == F.transform(named, folded), F.lit(False))
        return F.when((F.size(named) == 0) | same, rows).otherwise(F.concat(F.array(named), rows))

    # The text is parsed once for all its uses: as the only entry of an array.
    once = F.array(F.struct(_parsed(c).alias("rows"), _named(headers).alias("named")))
    return F.get(F.transform(once, joined), F.lit(0))


def has_table_rows(c: Column, headers: Column) -> Column:
    """Whether table_rows has any; a text under headers need not be parsed for that."""
    return F.coalesce(F.size(_named(headers)) > 0, F.lit(True)) | (F.size(_parsed(c)) > 0)


def _parsed(c: Column) -> Column:
    return F.filter(F.transform(lines_of(c), parse_row), lambda r: F.size(r) > 0)


def _named(headers: Column) -> Column:
    return F.filter(F.transform(headers, strip), lambda x: x != "")
