"""How wide texts are on a terminal, and their wrapping to a width, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

WORDS = 64  # wrapped at once

# Ranges of code points that take no cell (joiners, variation selectors, combining marks).
NO_CELL = (
    (0x0300, 0x036F), (0x0483, 0x0489), (0x0591, 0x05BD), (0x0610, 0x061A), (0x064B, 0x065F), (0x0670, 0x06D6), (0x0E31, 0x0E3A), (0x0E47, 0x0E4E), (0x0EB1, 0x0EB9),
    (0x0EBB, 0x0EBC), (0x0EC8, 0x0ECD), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x200C, 0x200D), (0x20D0, 0x20FF), (0x2CEF, 0x2CF1), (0x2DE0, 0x2DFF), (0xA66F, 0xA672),
    (0xA67C, 0xA67D), (0xA802, 0xA806), (0xA80B, 0xA823), (0xA825, 0xA826), (0xA82C, 0xA8C4), (0xFE00, 0xFE0F), (0xFE20, 0xFE2F), (0xE0100, 0xE01EF),
)
# Ranges of code points that take two cells (East Asian letters, symbols, emoji).
TWO_CELLS = (
    (0x1100, 0x11FF), (0x2316, 0x23FF), (0x2460, 0x24FF), (0x25A0, 0x27BF), (0x2934, 0x2935), (0x2B05, 0x2B55), (0x2E80, 0x9FFF), (0xA000, 0xA4CF), (0xAC00, 0xD7AF),
    (0xF900, 0xFAFF), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF01, 0xFF60), (0xFFE0, 0xFFE6), (0x1F000, 0x1F9FF), (0x1FA00, 0x1FAFF), (0x1FB00, 0x1FBFF),
)


def character_class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def width(text: Column) -> Column:
    """Cells that a text takes: one a character, none or two of the ranges above; null takes none."""
    t = F.coalesce(text, F.lit(""))
    rare = F.regexp_replace(t, r"[\x00-\x{2FF}]+", "")  # what is before all ranges takes one cell a character
    more = let(rare, lambda r: F.regexp_count(r, F.lit(character_class(TWO_CELLS))) - F.regexp_count(r, F.lit(character_class(NO_CELL))))
    return F.length(t) + F.when(F.octet_length(t) == F.length(t), 0).otherwise(more)


def wrapped(text: Column, cells: int) -> Column:
    """A text's words in lines of at most so many cells, greedily; a wider word has a line of its own. Words are what spaces part."""
    words = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != ""), lambda w: F.struct(w.alias("s"), width(w).alias("n")))
    line = lambda s, n: F.struct(s.alias("s"), n.cast("int").alias("n"))

    def put(acc: Column, word: Column) -> Column:
        s, n = word["s"], word["n"]
        fits = acc["n"] + 1 + n <= cells
        return F.when(acc["n"] < 0, line(s, n)).when(fits, line(F.concat(acc["s"], F.lit(" "), s), acc["n"] + 1 + n)).otherwise(line(F.concat(acc["s"], F.lit("\n"), s), n))

    # some words at a time, so that a long text isn't copied for each of its words
    last = lambda ws: F.greatest(F.floor((F.size(ws) - 1) / WORDS), F.lit(0)).cast("int")
    parts = let(words, lambda ws: F.transform(F.sequence(F.lit(0), last(ws)), lambda i: F.slice(ws, i * WORDS + 1, F.lit(WORDS))))
    more = lambda acc, ws: let(F.aggregate(ws, line(F.lit(""), acc["n"]), put), lambda part: line(F.concat(acc["s"], part["s"]), part["n"]))
    return F.aggregate(parts, line(F.lit(""), F.lit(-1)), more)["s"]
