"""Tables as lines of text, laid out by Spark: aggregates give the columns' types and widths, expressions the lines.

    lines = text_table(df, "id", fmt="grid")        # section, the order column, at, line
    write_text_table(lines, "id", folder)           # text parts in order

Rows are dealt to all cores. One pass over the cells finds each column's type, a second one writes them with their
decimals and widths below the shared folder; a row's lines are then one expression over what is written, without
lambdas where no cell spans lines. Only a row of numbers for each column reaches the driver, where the header and the
rules are made. Sections are 0 (above the rows), 1 (the rows) and 2 (below them); at counts the lines of a row.

Cells that span lines, by breaks of their own or wrapped to a width, make a row as high as its highest cell; this holds
for the formats of which rules and rows are drawn with lines (not markup). Long words begin on a line of their own
and are cut at the width. Colour codes take no width, wide characters two. An empty table gives its header and rules.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from ..functions import cells
from ..functions.pixels import bound
from .order import dense_index, written

#: The column of rows' numbers.
INDEX = "__index"
#: A header is at least so much narrower than its column.
HEADER_SPACE = 2


@dataclass(frozen=True)
class Rule:
    """A horizontal line: what begins it, fills the columns, stands between and ends it; ends: marks by alignment at
    both ends of a column."""

    begin: str = ""
    fill: str = ""
    between: str = ""
    end: str = ""
    ends: Mapping[str, tuple[str, str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Row:
    """A line of cells: begin, between and end of the line, before and after each cell, marks by alignment before it."""

    begin: str = ""
    between: str = ""
    end: str = ""
    before: str = ""
    after: str = ""
    marks: Mapping[str, str] = field(default_factory=dict)
    escape: Callable[[Column], Column] | None = None
    #: Whether spaces at the end of a line go.
    strip: bool = True


#: What a rule can be: nothing, a Rule, or a function of widths and alignments.
Drawn = Rule | Callable[[Sequence[int], Sequence[str]], str] | None


@dataclass(frozen=True)
class Format:
    """Rules and rows of a format, the spaces around a cell, the rules left out under a header, whether rows may be high."""

    above: Drawn = None
    under_header: Drawn = None
    between: Drawn = None
    below: Drawn = None
    header: Row = Row()
    row: Row = Row()
    pad: int = 0
    hidden: tuple[str, ...] = ()
    high: bool = True


def _boxed(above: str, under_header: str, between: str, below: str, bar: str) -> Format:
    """A box: its rules as four characters each (begin, fill, between, end), and the bar of its rows."""
    rule = lambda s: Rule(*s) if s else None
    return Format(rule(above), rule(under_header), rule(between), rule(below), Row(bar, bar, bar), Row(bar, bar, bar), 1)


# The characters and marks of the formats.
COLONS = {"right": ("", ":"), "decimal": ("", ":"), "center": (":", ":"), "left": (":", "")}
GRID_COLONS = {k: v for k, v in COLONS.items() if k != "decimal"}
STYLE = {"right": "text-align: right;", "center": "text-align: center;", "decimal": "text-align: right;"}
WIKI = {k: f'style="{v}"| ' for k, v in STYLE.items()}
MOIN = {k: f'<style="{v}">' for k, v in STYLE.items()}
HTML = {k: f' style="{v}"' for k, v in STYLE.items()}
TEXTILE = {"left": "<.", "right": ">.", "center": "=.", "decimal": ">."}
LATEX = {"left": "l", "right": "r", "center": "c", "decimal": "r"}
ASCIIDOC = {"left": "<", "right": ">", "center": "^", "decimal": ">"}
SPACED = Row("", "  ", "")
BAR = Row("|", "|", "|")


def _html(escape: Callable[[Column], Column] | None) -> Format:
    cell = lambda tag: Row("<tr>", "", "</tr>", f"<{tag}", f"</{tag}>", {"": ">", "left": ">"} | {k: f"{v}>" for k, v in HTML.items()}, escape)
    head = replace(cell("th"), begin="<table>\n<thead>\n<tr>", end="</tr>\n</thead>\n<tbody>")
    return Format(Rule("<table>\n<tbody>"), None, None, Rule("</tbody>\n</table>"), head, cell("td"), 0, ("above",), False)


def _latex(top: str, middle: str, bottom: str, name: str = "tabular", escape: Callable[[Column], Column] | None = cells.latex_escaped) -> Format:
    begin = lambda widths, aligns: f"\\begin{{{name}}}{{{''.join(LATEX.get(a, 'l') for a in aligns)}}}\n{top}"
    row = Row("", "&", "\\\\", escape=escape)
    return Format(begin, Rule(middle), None, Rule(f"{bottom}\n\\end{{{name}}}"), row, row, 1, high=False)


def _asciidoc(options: str) -> Callable[[Sequence[int], Sequence[str]], str]:
    return lambda widths, aligns: '[cols="' + ",".join(f"{w}{ASCIIDOC[a]}" for w, a in zip(widths, aligns, strict=True)) + f'"{options}]\n|===='


FORMATS: dict[str, Format] = {
    "simple": Format(Rule("", "-", "  ", ""), Rule("", "-", "  ", ""), None, Rule("", "-", "  ", ""), SPACED, SPACED, 0, ("above", "below")),
    "plain": Format(header=SPACED, row=SPACED),
    "grid": _boxed("+-++", "+=++", "+-++", "+-++", "|"),
    "simple_grid": _boxed("┌─┬┐", "├─┼┤", "├─┼┤", "└─┴┘", "│"),
    "rounded_grid": _boxed("╭─┬╮", "├─┼┤", "├─┼┤", "╰─┴╯", "│"),
    "heavy_grid": _boxed("┏━┳┓", "┣━╋┫", "┣━╋┫", "┗━┻┛", "┃"),
    "mixed_grid": _boxed("┍━┯┑", "┝━┿┥", "├─┼┤", "┕━┷┙", "│"),
    "double_grid": _boxed("╔═╦╗", "╠═╬╣", "╠═╬╣", "╚═╩╝", "║"),
    "fancy_grid": _boxed("╒═╤╕", "╞═╪╡", "├─┼┤", "╘═╧╛", "│"),
    "colon_grid": replace(_boxed("+-++", "", "+-++", "+-++", "|"), under_header=Rule("+", "=", "+", "+", GRID_COLONS)),
    "outline": _boxed("+-++", "+=++", "", "+-++", "|"),
    "simple_outline": _boxed("┌─┬┐", "├─┼┤", "", "└─┴┘", "│"),
    "rounded_outline": _boxed("╭─┬╮", "├─┼┤", "", "╰─┴╯", "│"),
    "heavy_outline": _boxed("┏━┳┓", "┣━╋┫", "", "┗━┻┛", "┃"),
    "mixed_outline": _boxed("┍━┯┑", "┝━┿┥", "", "┕━┷┙", "│"),
    "double_outline": _boxed("╔═╦╗", "╠═╬╣", "", "╚═╩╝", "║"),
    "fancy_outline": _boxed("╒═╤╕", "╞═╪╡", "", "╘═╧╛", "│"),
    "github": replace(_boxed("|-||", "|-||", "", "", "|"), hidden=("above",), high=False),
    "pipe": Format(Rule("|", "-", "|", "|", COLONS), Rule("|", "-", "|", "|", COLONS), None, None, BAR, BAR, 1, ("above",)),
    "orgtbl": _boxed("", "|-+|", "", "", "|"),
    "jira": Format(header=Row("||", "||", "||"), row=BAR, pad=1),
    "presto": Format(under_header=Rule("", "-", "+", ""), header=Row("", "|", ""), row=Row("", "|", ""), pad=1),
    "pretty": _boxed("+-++", "+-++", "", "+-++", "|"),
    "psql": _boxed("+-++", "|-+|", "", "+-++", "|"),
    "rst": Format(Rule("", "=", "  ", ""), Rule("", "=", "  ", ""), None, Rule("", "=", "  ", ""), SPACED, SPACED),
    "mediawiki": Format(Rule('{| class="wikitable" style="text-align: left;"', end="\n|+ <!-- caption -->\n|-"), Rule("|-"), Rule("|-"), Rule("|}"), Row("!", "!!", "", " ", " ", WIKI), Row("|", "||", "", " ", " ", WIKI), high=False),
    "moinmoin": Format(header=Row("", "", "||", "||", "''' ", {k: f"{v} '''" for k, v in MOIN.items()} | {"": " '''", "left": " '''"}), row=Row("", "", "||", "||", " ", {k: f"{v} " for k, v in MOIN.items()} | {"": " ", "left": " "}), pad=1, high=False),
    "youtrack": Format(header=Row("|| ", " || ", " || "), row=Row("| ", " | ", " |"), pad=1, high=False),
    "html": _html(cells.html_escaped),
    "unsafehtml": _html(None),
    "latex": _latex("\\hline", "\\hline", "\\hline"),
    "latex_raw": _latex("\\hline", "\\hline", "\\hline", escape=None),
    "latex_booktabs": _latex("\\toprule", "\\midrule", "\\bottomrule"),
    "latex_longtable": _latex("\\hline", "\\hline\n\\endhead", "\\hline", "longtable"),
    "tsv": Format(header=Row("", "\t", ""), row=Row("", "\t", ""), high=False),
    "textile": Format(header=Row("|_. ", "|_.", "|"), row=Row("|", "|", "|", marks=TEXTILE), pad=1, high=False),
    "asciidoc": Format(_asciidoc(""), None, None, Rule("|===="), Row("|", "|", "", strip=False), Row("|", "|", "", strip=False), 1, ("above",), False),
}


def separated(mark: str) -> Format:
    """A format whose rows are cells with one mark between them."""
    return Format(header=Row("", mark, ""), row=Row("", mark, ""), high=False)


# --- cells ----------------------------------------------------------------------------------------------------------


def general(x: Column, digits: int = 6) -> Column:
    """A number with so many significant digits: as a decimal if its exponent is from -4 to digits - 1, else scientific;
    without zeros at its end."""
    short = lambda t: F.regexp_replace(t, r"\.?0*$", "")

    def laid_out(s: Column) -> Column:
        figures, power = s["figures"], s["power"]
        whole = F.concat(F.rpad(F.substring(figures, F.lit(1), power + 1), power + 1, "0"), F.lit("."), F.substring(figures, power + 2, F.lit(digits)))
        far = F.concat(short(F.concat(F.substring(figures, 1, 1), F.lit("."), F.substring(figures, 2, digits))), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), figures)
        return F.when((power >= digits) | (power < -4), far).when(power >= 0, short(whole)).otherwise(short(small))

    parts = lambda w: F.struct(F.regexp_replace(F.element_at(F.split(w, "e"), 1), r"\.", "").alias("figures"), F.element_at(F.split(w, "e"), 2).cast("int").alias("power"))
    finite = F.abs(x) < float("inf")
    size = bound(F.format_string(f"%.{digits - 1}e", F.when(finite, F.abs(x)).otherwise(0.0)), lambda w: bound(parts(w), laid_out))
    return F.when(x.isNotNull(), F.when(F.isnan(x), "nan").otherwise(F.concat(F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise(""), F.when(finite, size).otherwise("inf"))))


def _fixed(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", x)


#: How a float is written: "g", "g" with digits, or "f" with decimals.
def number_text(cell: Column, style: str = "g") -> Column:
    x = F.replace(F.trim(cells.plain(cell)), F.lit(","), F.lit("")).try_cast("double")
    kind, places = style[-1:], style[:-1].lstrip(".")
    if kind in "gf" and (not places or places.isdigit()):
        write = general if kind == "g" else _fixed
        return F.coalesce(bound(x, lambda v: F.when(v.isNotNull(), write(v, int(places or 6)))), cell)
    raise ValueError(f"{style!r} is no style of numbers; g, .4g, f and .2f are")


def as_cell(column: Column, kind) -> Column:
    """A value as the text of a cell; truth values as True and False, bytes as UTF-8, nulls stay."""
    if isinstance(kind, BooleanType):
        return F.when(column, "True").when(~column, "False")
    return cells.as_text(column) if isinstance(kind, BinaryType) else column.cast("string")


def wrapped(cell: Column, width: int) -> Column:
    """A cell's text in lines of at most `width` characters, broken at white space, or within words that are longer."""
    lines = F.transform(F.split(cell, "\n"), lambda t: F.transform(F.regexp_extract_all(t, F.lit(rf".{{1,{width}}}(?:\s+|$)|\S{{{width}}}"), F.lit(0)), lambda x: F.rtrim(x)))
    return F.array_join(F.flatten(F.transform(lines, lambda x: F.when(F.size(x) == 0, F.array(F.lit(""))).otherwise(x))), "\n")


def padded(cell: Column, width: int, side: str, taken: Column | None = None) -> Column:
    """Spaces up to a width on the screen; taken: the cell's own width, if it is known."""
    more = F.greatest(F.lit(width) - (cells.display_width(cell) if taken is None else taken), F.lit(0))
    spaces = lambda n: F.repeat(F.lit(" "), n.cast("int"))
    if side == "center":
        return F.concat(spaces(F.floor(more / 2)), cell, spaces(F.ceil(more / 2)))
    return F.concat(spaces(more), cell) if side in ("right", "decimal") else F.concat(cell, spaces(more))


def _pad_text(text: str, width: int, side: str) -> str:
    more = max(width - len(text), 0)
    return " " * (more // 2) + text + " " * (more - more // 2) if side == "center" else " " * more + text if side in ("right", "decimal") else text + " " * more


# --- lines ----------------------------------------------------------------------------------------------------------


def _rule(rule: Drawn, widths: Sequence[int], aligns: Sequence[str]) -> list[str]:
    if rule is None:
        return []
    if callable(rule):
        return rule(widths, aligns).split("\n")
    ends = [rule.ends.get(a, ("", "")) for a in aligns]
    parts = [a + rule.fill * (w - len(a) - len(b)) + b for w, (a, b) in zip(widths, ends, strict=True)]
    return (rule.begin + rule.between.join(parts) + rule.end).rstrip().split("\n")


def _line(row: Row, values: Sequence[Column], aligns: Sequence[str], pad: int) -> Column:
    """One line of cells."""
    parts = []
    for k, (v, a) in enumerate(zip(values, aligns, strict=True)):
        v = F.concat(F.lit(" " * pad), v, F.lit(" " * pad)) if pad else v
        v = row.escape(v) if row.escape else v
        v = F.concat(v, F.lit(" ")) if row.marks is TEXTILE and k == 0 else v
        parts += [F.lit((row.between if k else "") + row.before + row.marks.get(a, "")), v, F.lit(row.after)]
    line = F.concat(F.lit(row.begin), *parts, F.lit(row.end))
    return F.rtrim(line) if row.strip else line


@dataclass(frozen=True)
class Layout:
    """What a table is laid out by."""

    fmt: str | Format = "simple"
    #: Names by column; None leaves the header out.
    headers: Mapping[str, str] | None = field(default_factory=dict)
    float_style: str = "g"
    missing: str | Mapping[str, str] = ""
    number_align: str = "decimal"
    text_align: str = "left"
    aligns: Mapping[str, str] = field(default_factory=dict)
    header_aligns: Mapping[str, str] = field(default_factory=dict)
    parse_numbers: bool = True
    max_widths: Mapping[str, int] | int | None = None
    row_align: str = "top"
    keep_space: bool = False
    #: A column that is true where a line is drawn in place of the row.
    separators: str | None = None
    #: Whether the rows' numbers, from 0 in their order, come first.
    index: bool = False


def text_table(df: DataFrame, order: str, layout: Layout = Layout(), **changes) -> DataFrame:
    """section, the order column, at and line of a table's text; the order column is not shown unless it is listed twice
    by another name. changes: fields of the layout."""
    layout = replace(layout, **changes)
    own = FORMATS.get(layout.fmt, FORMATS["simple"]) if isinstance(layout.fmt, str) else layout.fmt
    pretty = layout.fmt == "pretty"
    if layout.index:
        df = dense_index(df, order, to=INDEX)
        df = df.select(INDEX, *[c for c in df.columns if c != INDEX])
        layout = replace(layout, headers=None if layout.headers is None else {INDEX: ""} | dict(layout.headers))
    names = [c for c in df.columns if c not in (order, layout.separators)]
    numbers = layout.parse_numbers and not pretty
    texts = {c: as_cell(F.col(f"`{c}`"), df.schema[c].dataType) for c in names}
    rows = df.select(order, *([layout.separators] if layout.separators else []), *[t.alias(f"c{k}") for k, t in enumerate(texts.values())])
    shown_of = lambda rows: rows.filter(~F.coalesce(F.col(layout.separators), F.lit(False))) if layout.separators else rows
    at = [f"c{k}" for k in range(len(names))]
    if not names:
        return rows.select(F.lit(1).alias("section"), order, F.lit(0).alias("at"), F.lit("").alias("line")).limit(0)

    # a small file is one or a few partitions, and laying out costs far more than moving the rows
    spread = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(spread, *rows.columns)
    ranks = shown_of(rows).agg(*[F.max(cells.type_rank(F.col(c))).alias(c) for c in at]).first() if numbers else None
    rank = [max(1, (ranks[c] or 0)) if ranks else 5 for c in at]
    missing = lambda n: layout.missing if isinstance(layout.missing, str) else layout.missing.get(n, "")
    limit = lambda n: layout.max_widths if isinstance(layout.max_widths, int) or layout.max_widths is None else layout.max_widths.get(n)

    def cell(k: int, n: str) -> Column:
        c = F.col(at[k])
        text = number_text(c, layout.float_style) if rank[k] == 3 else c
        text = F.coalesce(F.when(c == "", c).otherwise(text), F.lit(missing(n))) if rank[k] in (2, 3) else F.coalesce(c, F.lit(missing(n)))
        text = wrapped(text, limit(n)) if limit(n) else text
        return text if layout.keep_space or rank[k] in (2, 3) else F.array_join(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), "\n")

    usual = ["center" if pretty else layout.number_align if r in (2, 3) else layout.text_align for r in rank]
    aligns = [layout.aligns.get(n, u) for n, u in zip(names, usual, strict=True)]
    # each step is a projection of its own, or expressions would hold one another many times over
    settled_cells = {c: cell(k, n) for k, (c, n) in enumerate(zip(at, names, strict=True))}
    if layout.fmt == "rst":
        settled_cells["c0"] = cells.rst_first(settled_cells["c0"])
    decimal = [k for k, a in enumerate(aligns) if a == "decimal"]
    measured = {f"d{k}": cells.decimals(F.col(at[k])) for k in decimal} | {f"w{k}": cells.visible_width(F.col(c)) for k, c in enumerate(at)}
    # written, or every use of a cell in the lines below would make and measure it again
    rows = written(rows.withColumns(settled_cells).withColumns(measured))
    own_decimals = [F.col(f"d{k}") if k in decimal else F.lit(0) for k in range(len(names))]
    stats = shown_of(rows).agg(*[F.max(d).alias(f"d{k}") for k, d in enumerate(own_decimals)], *[F.max(F.col(f"w{k}") - d).alias(f"w{k}") for k, d in enumerate(own_decimals)], F.min(order).alias("first")).first()
    most = [stats[f"d{k}"] if stats[f"d{k}"] is not None else 0 for k in range(len(names))]
    titles = [layout.headers.get(n, n) for n in names] if layout.headers is not None else []
    least = [len(t) + (0 if pretty else HEADER_SPACE) for t in titles] or [0] * len(names)
    widths = [max(b, (stats[f"w{k}"] if stats[f"w{k}"] is not None else 0) + max(most[k], 0 if a != "decimal" else -1)) for k, (b, a) in enumerate(zip(least, aligns, strict=True))]
    spaced = [w + 2 * own.pad for w in widths]

    between = _rule(own.between, spaced, aligns)
    pointed = {f"c{k}": F.concat(F.col(f"c{k}"), F.repeat(F.lit(" "), (F.lit(most[k]) - F.col(f"d{k}")).cast("int"))) for k in decimal}
    behind = [F.greatest(F.lit(most[k]) - F.col(f"d{k}"), F.lit(0)) if k in decimal else F.lit(0) for k in range(len(names))]
    single = _line(own.row, [padded(pointed.get(c, F.col(c)), widths[k], aligns[k], F.col(f"w{k}") + behind[k]) for k, c in enumerate(at)], aligns, own.pad)
    if own.high:
        flat = ~F.contains(F.concat(*at), F.lit("\n"))
        rows = rows.withColumns({"single": F.when(flat, F.array(single))} | pointed)
        # lines of a cell, moved down to where the row's alignment wants them
        rows = rows.withColumns({c: F.split(c, "\n") for c in at})
        rows = rows.withColumn("height", F.greatest(*[F.size(c) for c in at]) if len(at) > 1 else F.size("c0"))
        down = {"top": lambda c: F.lit(0), "bottom": lambda c: F.col("height") - F.size(c), "center": lambda c: F.floor((F.col("height") - F.size(c)) / 2).cast("int")}[layout.row_align]
        place = lambda c, k: F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda i: padded(F.coalesce(F.get(F.col(c), i - down(c)), F.lit("")), widths[k], aligns[k]))
        rows = rows.withColumns({c: place(c, k) for k, c in enumerate(at)})
        drawn = F.coalesce("single", F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda i: _line(own.row, [F.get(F.col(c), i) for c in at], aligns, own.pad)))
    else:
        # cells that span lines are padded by what all of their text takes
        whole = {c: padded(pointed.get(c, F.col(c)), widths[k], aligns[k]) for k, c in enumerate(at)}
        drawn = F.array(F.when(~F.contains(F.concat(*at), F.lit("\n")), single).otherwise(_line(own.row, list(whole.values()), aligns, own.pad)))
    if between:
        drawn = F.when(F.col(order) == F.lit(stats["first"]), drawn).otherwise(F.concat(F.array(*[F.lit(b) for b in between]), drawn))
    if layout.separators:
        mark = between or _rule(own.under_header, spaced, aligns) or _rule(own.below, spaced, aligns) or _rule(own.above, spaced, aligns) or [""]
        drawn = F.when(F.coalesce(F.col(layout.separators), F.lit(False)), F.array(*[F.lit(m) for m in mark])).otherwise(drawn)
    rows = rows.withColumn("drawn", drawn)
    body = rows.select(F.lit(1).alias("section"), order, F.posexplode("drawn").alias("at", "line"))

    hidden = own.hidden if titles else ()
    head_aligns = [layout.header_aligns.get(n, a) for n, a in zip(names, aligns, strict=True)]
    head = [] if "above" in hidden else _rule(own.above, spaced, aligns)
    spark = df.sparkSession
    if titles:
        if callable(own.above) and layout.fmt == "asciidoc":
            head += _asciidoc(',options="header"')(spaced, aligns).split("\n")
        cellsof = [F.lit(_pad_text(t, w, a)) for t, w, a in zip(titles, widths, head_aligns, strict=True)]
        titled = spark.range(1).select(_line(own.header, cellsof, head_aligns, own.pad)).first()[0]
        head += [*titled.split("\n"), *_rule(own.under_header, spaced, aligns)]
    foot = [] if "below" in hidden else _rule(own.below, spaced, aligns)
    ends = [(0, k, t) for k, t in enumerate(head)] + [(2, k, t) for k, t in enumerate(foot)]
    if not ends:
        return body
    edge = F.array(*[F.struct(F.lit(a).alias("section"), F.lit(None).cast(df.schema[order].dataType).alias(order), F.lit(k).alias("at"), F.lit(t).alias("line")) for a, k, t in ends])
    edge = spark.range(1).select(F.inline(edge))
    return body.unionByName(edge)


def write_text_table(lines: DataFrame, order: str, folder: str) -> None:
    """The lines in order, as parts of text whose names follow it."""
    lines.orderBy("section", order, "at").select("line").write.mode("overwrite").text(folder)
