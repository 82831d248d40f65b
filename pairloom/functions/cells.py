"""Types of text cells and what number formatting needs, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types by rank, the least general first; fixed values.
TYPES = ("none", "bool", "int", "float", "bytes", "str")
ANSI = r"\x1b(\[[0-9;]*[A-Za-z]|\]8;[^;]*;[^\x1b]*\x1b\\)"
#: Characters that are never wide and never flat (the soft hyphen is among them).
NEAR = r"[\x{0}-\x{2FF}]+"
#: HTML and LaTeX escapes; fixed values.
HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
LATEX = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "^": r"\^{}", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "\\": r"\textbackslash{}", "<": r"\ensuremath{<}", ">": r"\ensuremath{>}"}


def plain(cell: Column) -> Column:
    """Without colour codes and link escapes."""
    return F.regexp_replace(cell, ANSI, "")


def _class(wanted: Callable[[str], bool]) -> str:
    """A regular expression's class of the code points that a rule on characters picks, as intervals."""
    spans: list[list[int]] = []
    for code in range(0x20, 0x110000):
        if wanted(chr(code)):
            if spans and spans[-1][1] == code - 1:
                spans[-1][1] = code
            else:
                spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


@cache
def wide_class() -> str:
    """Characters that take two columns: East Asian wide and full-width ones that are no marks."""
    return _class(lambda c: unicodedata.east_asian_width(c) in "WF" and unicodedata.category(c) not in ("Mn", "Me", "Cf"))


@cache
def flat_class() -> str:
    """Characters that take none: marks that combine, and format characters other than the soft hyphen."""
    return _class(lambda c: unicodedata.category(c) in ("Mn", "Me", "Cf") and c != "\xad")


def display_width(text: Column) -> Column:
    """Columns that a line takes on a screen: escapes and marks none, wide characters two; null for null."""
    bare = plain(text)
    # no character below U+0300 is wide or flat, and the classes are long: only what is left is held against them
    far = F.regexp_replace(bare, NEAR, "")
    counted = F.length(bare) + F.regexp_count(far, F.lit(wide_class())) - F.regexp_count(far, F.lit(flat_class()))
    return F.when((F.octet_length(text) == F.length(text)) & ~F.contains(text, F.lit("\x1b")), F.length(text)).otherwise(counted).cast("int")


def visible_width(cell: Column) -> Column:
    """The columns of a cell's widest line."""
    return F.array_max(F.transform(F.split(cell, "\n"), display_width))


def is_thousands(cell: Column) -> Column:
    """Groups of three digits after commas, at most three digits before; a fraction may follow or stand alone."""
    return cell.rlike(r"^([+-]?[0-9]{1,3}(,[0-9]{3})*(\.[0-9]*)?|(\.[0-9]+)?)$")


def is_int(cell: Column) -> Column:
    return cell.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$") | (is_thousands(cell) & cell.rlike("[0-9]") & ~cell.contains("."))


def is_number(cell: Column) -> Column:
    """A float; one that overflows is none unless infinity is meant."""
    named = F.lower(F.trim(cell)).rlike(r"^[+-]?(inf|infinity|nan)$")
    written = cell.rlike(r"^\s*[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?\s*$")
    value = F.expr("double('inf')")
    fits = F.abs(F.regexp_replace(F.trim(cell), "_", "").try_cast("double")) < value
    return named | (written & F.coalesce(fits, F.lit(False))) | (is_thousands(cell) & cell.rlike("[0-9]"))


def is_bool(cell: Column) -> Column:
    return cell.isin("True", "False")


def type_rank(cell: Column) -> Column:
    """The place in TYPES of the least general type of a text cell; null and empty cells are none."""
    bare = plain(cell)
    return F.when(cell.isNull() | (cell == ""), 0).when(is_bool(bare), 1).when(is_int(bare), 2).when(is_number(bare), 3).otherwise(5)


def type_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TYPES]), rank + 1)


def column_types(cells: DataFrame) -> DataFrame:
    """column and type: the most general type of its cells, bool for a column of empty ones."""
    return cells.groupBy("column").agg(F.greatest(F.max(type_rank(F.col("cell"))), F.lit(1)).alias("rank")).select("column", type_name(F.col("rank")).alias("type"))


def decimals(cell: Column) -> Column:
    """Characters after the point, or after an e; -1 for whole numbers and other text."""
    bare = plain(cell)
    point, e = F.instr(bare, "."), F.instr(F.lower(bare), "e")
    place = F.when(point > 0, point).when(e > 0, e)
    return F.when(~is_number(bare) | is_int(bare) | place.isNull(), -1).otherwise(F.length(bare) - place)


def column_widths(cells: DataFrame) -> DataFrame:
    """column, width (the most visible characters) and decimals (the most)."""
    return cells.groupBy("column").agg(F.max(F.length(plain(F.coalesce("cell", F.lit(""))))).alias("width"), F.max(decimals(F.col("cell"))).alias("decimals"))


def padded(cell: Column, width: Column, side: str) -> Column:
    """Spaces up to a width; longer cells stay whole."""
    more = F.greatest(width - F.length(plain(cell)), F.lit(0))
    if side == "right":
        return F.concat(F.repeat(F.lit(" "), more), cell)
    if side == "center":
        return F.concat(F.repeat(F.lit(" "), F.floor(more / 2).cast("int")), cell, F.repeat(F.lit(" "), F.ceil(more / 2).cast("int")))
    return F.concat(cell, F.repeat(F.lit(" "), more)) if side == "left" else cell


def point_aligned(cell: Column, width: Column, most: Column) -> Column:
    """Padded so that points stand below each other: `most` is the column's most decimals."""
    own = decimals(cell)
    behind = F.when(most > own, most - own).otherwise(F.lit(0)) 
    return padded(F.concat(cell, F.repeat(F.lit(" "), behind.cast("int"))), width, "right")


def html_escaped(cell: Column) -> Column:
    for a, b in HTML:
        cell = F.replace(cell, F.lit(a), F.lit(b))
    return cell


def latex_escaped(cell: Column) -> Column:
    """Each character on its own, so nothing is escaped twice."""
    table = F.create_map(*[F.lit(x) for pair in LATEX.items() for x in pair])
    return F.array_join(F.transform(F.split(cell, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")


def rst_first(cell: Column) -> Column:
    """Two dots for an empty cell in the first column."""
    return F.when(F.trim(cell) == "", "..").otherwise(cell)


#: Stands for replacement characters that a text has of its own, while others are taken out.
OWN = "\uf8ff\x00\uf8fe"


def as_text(data: Column) -> Column:
    """Bytes as UTF-8; what is none goes."""
    text = F.make_valid_utf8(F.replace(data.cast("string"), F.lit("\ufffd"), F.lit(OWN)))
    return F.replace(F.replace(text, F.lit("\ufffd"), F.lit("")), F.lit(OWN), F.lit("\ufffd"))


def checkpoint_step(path: Column) -> Column:
    return F.element_at(F.split(F.element_at(F.split(path, "/"), -1), "-"), -1).try_cast("long")
