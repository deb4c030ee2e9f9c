"""Text and tables of pages given as positioned pieces of text; y grows upwards.

A page is one row and is read within it, by functions over its sorted pieces: lines are runs of falling y, columns are runs of the left edges that lines
share, cells are a line's pieces in a column. Only rows that share id and page meet by a shuffle, so pieces themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, runs

# Fallbacks and thresholds of lines, word gaps, paragraphs and tables.
HEIGHT, CHARACTER = 10.0, 5.0
SAME_LINE, PARAGRAPH = 0.5, 1.2
WORD_GAP, SIGN_GAP = 0.5, 0.35
FEWEST_PIECES, FEWEST_ROWS, FEWEST_COLUMNS, FULL_ROWS = 6, 3, 2, 0.6
COLUMN_CHARACTERS, COLUMN_UNITS = 2, 10

_PAGE = ("id", "page")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def _sorted(items: Column) -> Column:
    """Items that have a text, numbered from the top left; null positions are 0."""
    number = lambda i, c: F.coalesce(F.nanvl(i[c].cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
    down = lambda i: (-F.coalesce(F.nanvl(i["y"].cast("double"), F.lit(0.0)), F.lit(0.0))).alias("down")
    said = F.filter(F.coalesce(items, F.array().cast("array<struct<str:string,x:double,y:double,width:double,height:double>>")), lambda i: i["str"].isNotNull())
    placed = F.sort_array(F.transform(said, lambda i: F.struct(down(i), number(i, "x"), i["str"].alias("str"), number(i, "width"), number(i, "height"))))
    return F.transform(placed, lambda p, i: F.struct(p["x"].alias("x"), (i + 1).alias("n"), p["str"].alias("str"), (-p["down"]).alias("y"), p["width"].alias("width"), p["height"].alias("height")))


def _lines(pieces: Column) -> Column:
    """Sorted pieces by line, each line from left to right. A line ends where y falls by over half of the page's (upper) median height."""
    heights = F.sort_array(F.filter(F.transform(pieces, lambda p: p["height"]), lambda h: h > 0))
    typical = let(heights, lambda h: F.coalesce(F.get(h, F.floor(F.size(h) / 2).cast("int")), F.lit(HEIGHT)))
    return let(typical, lambda tall: F.transform(runs(pieces, lambda a, b: a["y"] - b["y"] > SAME_LINE * tall), lambda line: F.sort_array(line)))


def pieces_of(pages: DataFrame) -> DataFrame:
    """(id, page, n, str, x, y, width, height) of every item that has a text; null positions are 0. Rows that share id and page are one page."""
    return _whole(pages).select(*_PAGE, F.explode(_sorted(F.col("items"))).alias("p")).select(*_PAGE, *(f"p.{c}" for c in ("n", "str", "x", "y", "width", "height")))


def in_lines(pieces: DataFrame) -> DataFrame:
    """Pieces with their line, from 1 at the top."""
    lines = let(_sorted(F.collect_list(F.struct("str", "x", "y", "width", "height"))), _lines)
    lined = pieces.groupBy(*_PAGE).agg(lines.alias("lines")).select(*_PAGE, F.posexplode("lines").alias("line", "ps"))
    return lined.select(*_PAGE, (F.col("line") + 1).alias("line"), F.explode("ps").alias("p")).select(*_PAGE, *(f"p.{c}" for c in ("n", "str", "x", "y", "width", "height")), "line")


def _text(lines: Column) -> Column:
    """Spaces where the gap between pieces is a good part of a character, blank lines where lines are far apart."""

    def apart(before: Column, piece: Column) -> Column:
        signs = F.length(before["str"])
        return piece["x"] - before["x"] - before["width"] > before["width"] / F.greatest(F.lit(1), signs) * F.when(signs > 1, WORD_GAP).otherwise(SIGN_GAP)

    said = lambda line: F.array_join(F.transform(line, lambda p, i: F.when((i > 0) & apart(F.get(line, i - 1), p), F.concat(F.lit(" "), p["str"])).otherwise(p["str"])), "")
    told = F.transform(lines, lambda line: F.struct(
        said(line).alias("said"), F.get(line, F.lit(0))["y"].alias("first_y"), F.element_at(line, -1)["y"].alias("last_y"), _sum(F.transform(line, lambda p: p["height"])).alias("tall"), F.size(line).alias("many"),
    ))
    far = lambda above, line: above["last_y"] - line["first_y"] > PARAGRAPH * (above["tall"] + line["tall"]) / (above["many"] + line["many"])
    broken = lambda ls: F.transform(ls, lambda l, i: F.concat(F.when(i == 0, "").when(far(F.get(ls, i - 1), l), "\n\n").otherwise("\n"), l["said"]))
    return _strip(F.regexp_replace(F.array_join(let(told, broken), ""), r"\n{3,}", "\n\n"))


def _edge(piece: Column) -> Column:
    return F.floor(piece["x"] + 0.5)


def _columns(pieces: Column, lines: Column) -> Column:
    """array<struct<low, high>>: left edges that at least two lines of several pieces share, near ones together; null where the page has too little for a table."""
    signs = F.filter(F.transform(pieces, lambda p: p["width"] / F.greatest(F.lit(1), F.length(p["str"]))), lambda s: s > 0)
    near = let(signs, lambda s: F.greatest(COLUMN_CHARACTERS * F.when(F.size(s) > 0, _sum(s) / F.size(s)).otherwise(F.lit(CHARACTER)), F.lit(float(COLUMN_UNITS))))
    several = F.filter(lines, lambda line: F.size(line) > 1)

    def shared(near: Column, ls: Column) -> Column:
        edges = F.sort_array(F.flatten(F.transform(ls, lambda line: F.array_distinct(F.transform(line, _edge)))))
        islands = let(edges, lambda e: F.filter(runs(e, lambda a, b: b - a > near), lambda run: F.size(run) > 1))
        return F.transform(islands, lambda run: F.struct((F.get(run, F.lit(0)) - near / 2).alias("low"), (F.element_at(run, -1) + near / 2).alias("high")))

    enough = (F.size(pieces) >= FEWEST_PIECES) & (F.size(lines) >= FEWEST_ROWS)
    found = let(several, lambda ls: F.when(F.size(ls) > 1, let(near, lambda n: shared(n, ls))))
    return F.when(enough, let(found, lambda columns: F.when(F.size(columns) >= FEWEST_COLUMNS, columns)))


def _column(piece: Column, columns: Column) -> Column:
    """The number of the column that holds a piece's left edge, 0 outside of all."""
    return let(_edge(piece), lambda edge: F.array_position(F.transform(columns, lambda c: (edge >= c["low"]) & (edge <= c["high"])), True))


def _table(lines: Column, columns: Column) -> Column:
    """The grid as Markdown, of a page where three lines of five fill all columns; else null."""
    share = lambda what: F.size(F.filter(*what)) / F.size(what[0]) >= FULL_ROWS
    numbered = lambda line: F.transform(line, lambda p: F.struct(_column(p, columns).alias("column"), p["str"].alias("str")))
    cell = lambda line, c: _strip(F.array_join(F.transform(F.filter(line, lambda p: p["column"] == c), lambda p: p["str"]), ""))
    row = lambda line: let(numbered(line), lambda ps: F.transform(F.sequence(F.lit(1), F.size(columns)), lambda c: cell(ps, c)))
    bars = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    grid = lambda rows: F.concat(F.slice(rows, 1, 1), F.array(F.array_repeat(F.lit("---"), F.size(columns))), F.slice(rows, F.lit(2), F.size(rows)))
    shown = lambda rows: F.when(share((rows, lambda r: F.forall(r, lambda c: c != ""))), F.array_join(F.transform(grid(rows), bars), "\n"))
    # a line of fewer pieces than columns can't fill them: where such lines are too many, no cell is read
    return F.when(share((lines, lambda line: F.size(line) >= F.size(columns))), let(F.transform(lines, row), shown))


def _page(pieces: Column) -> Column:
    """struct<text, table> of a page's sorted pieces."""

    def told(lines: Column, columns: Column, table: Column) -> Column:
        rest = F.filter(pieces, lambda p: _column(p, columns) == 0)
        return F.struct(F.when(table.isNull(), _text(lines)).otherwise(let(let(rest, _lines), _text)).alias("text"), table.alias("table"))

    tabled = lambda lines, columns: let(F.when(columns.isNotNull(), _table(lines, columns)), lambda table: told(lines, columns, table))
    return let(_lines(pieces), lambda lines: let(_columns(pieces, lines), lambda columns: tabled(lines, columns)))


def _whole(pages: DataFrame) -> DataFrame:
    return pages.groupBy(*_PAGE).agg(F.flatten(F.collect_list("items")).alias("items"))


def read_pages(pages: DataFrame, whole: bool = False) -> DataFrame:
    """(id, page, items array<struct<str,x,y,width,height>>) to (id, page, text, table): the text outside a table, and the table or null.

    Null items and items without a text are left out, null positions are 0; a page without items has an empty text. Rows that share id and page are
    one page; if none do, whole spares the shuffle that brings them together.
    """
    rows = pages if whole else _whole(pages)
    return rows.select(*_PAGE, let(_sorted(F.col("items")), _page).alias("p")).select(*_PAGE, "p.text", "p.table")
