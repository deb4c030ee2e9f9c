"""Chapters, contents pages and required sections of texts.

Numbered chapter headings are found by JVM expressions within each row: a cheap pattern picks candidate lines, whose numerals are
then read. Only texts without any go to Arrow batches, for the headings of their markup. Nothing is shuffled.
"""

from __future__ import annotations

import re
from itertools import accumulate
from statistics import median
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words for a chapter, and lines that head a table of contents.
CHAPTER_WORDS = ("chapter", "chapitre", "kapitel", "capitulo", "capítulo", "capitolo", "hoofdstuk", "ch.", "ch")
THAI_WORDS = ("บทที่", "ตอนที่", "ภาคที่", "บท", "ตอน", "ภาค")
HAN_ORDINAL, KOREAN_ORDINAL, KOREAN_BRANCH = "第", "제", "의"
CONTENTS = ("table of contents", "contents", "índice", "sumário", "sumario", "table des matières", "inhaltsverzeichnis", "indice", "sommario", "inhoudsopgave")
CONTENTS_HAN = r"目[ \t\x{3000}]*(?:录|錄|次)"
# Numerals.
ROMAN = ((100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
ROMAN_SIGNS = "IVXLCDM"
HAN_DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
HAN_UNITS = {"十": 10, "百": 100, "千": 1000}
THAI_DIGITS, WIDE_DIGITS = "๐๑๒๓๔๕๖๗๘๙", "０１２３４５６７８９"
# What parts a number from its title, what a title begins with, and signs of a chapter after its number.
PARTING, ROMAN_PARTING, HAN_PARTING, KOREAN_PARTING = ".:-—–", ":.", "·、.:：", ".:-"
TITLE_BEGINS, MARKED_TITLE_BEGINS = r'[A-ZÀ-Þ0-9"“(]', r'[A-Za-zÀ-Þ"“(]'
HAN_CHAPTERS, KOREAN_CHAPTERS = "章回卷节篇讲", "장편절관"
# Limits of headings, of numbered titles, of the search for contents, of samples.
LONGEST_HEADING, LARGEST_ROMAN, LARGEST_HAN = 80, 200, 999
FEWEST_NUMBERED, SHORTEST_BODY = 3, 200
CONTENTS_WITHIN, SAMPLE = 30_000, 10
# Sections that a plan must have.
PLAN_SECTIONS = ("Overall Approach", "Important Notes", "Open Questions", "Execution Phases", "Proposed Changes", "Verification Plan")

_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
_HAN = "".join(HAN_DIGITS) + "".join(HAN_UNITS)
_CHAPTER = "|".join(map(re.escape, CHAPTER_WORDS))
_OPENER = rf"(?i:{_CHAPTER})|{'|'.join(THAI_WORDS)}|{HAN_ORDINAL}|{KOREAN_ORDINAL}"
#: A line in four fields: markup prefix, word for a chapter, run of one kind of numeral, the rest.
_FIELDS = rf"(?U)^(?:(#{{1,6}}|={{1,6}})\s+)?({_OPENER})?\s*([0-9{WIDE_DIGITS}{THAI_DIGITS}]+|(?i:[{ROMAN_SIGNS}]+)|[0-9{WIDE_DIGITS}{_HAN}]+)(.*)$"


def roman(n: int) -> str:
    out = ""
    for value, sign in ROMAN:
        out, n = out + sign * (n // value), n % value
    return out


def _roman_value(sign: Column) -> Column:
    """Canonical numerals up to LARGEST_ROMAN by their place in the list of all; null for others."""
    place = F.array_position(F.array(*(F.lit(roman(n)) for n in range(1, LARGEST_ROMAN + 1))), F.upper(sign))
    return F.when(place > 0, place).cast("int")


def _han_value(sign: Column) -> Column:
    """Arabic digits of either width, else digits times units summed; null outside 1 to LARGEST_HAN."""
    plain = F.translate(sign, WIDE_DIGITS, "0123456789")
    digit = F.create_map(*(F.lit(x) for kv in HAN_DIGITS.items() for x in kv))
    unit = F.create_map(*(F.lit(x) for kv in HAN_UNITS.items() for x in kv))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))

    def step(acc: Column, c: Column) -> Column:
        u = F.try_element_at(unit, c)
        grown = acc["total"] + F.greatest(acc["last"], F.lit(1)) * F.coalesce(u, F.lit(0))
        return F.struct(grown.alias("total"), F.when(u.isNotNull(), 0).otherwise(F.coalesce(F.try_element_at(digit, c), F.lit(0))).alias("last"))

    composed = F.aggregate(F.split(plain, ""), zero, step, lambda acc: acc["total"] + acc["last"])
    value = F.when(plain.rlike("^[0-9]+$"), plain.try_cast("int")).when(plain.rlike("[0-9]"), None).otherwise(composed)
    return F.when(value.between(1, LARGEST_HAN), value)


def _led(rest: Column) -> tuple[Column, Column]:
    """Whether white space leads, and what follows it."""
    bare = F.regexp_replace(rest, r"(?U)^\s+", "")
    return F.length(bare) < F.length(rest), bare


def _begins(rest: Column, signs: str) -> Column:
    """Whether the first character is one of these signs."""
    return (rest != "") & F.contains(F.lit(signs), F.substring(rest, 1, 1))


def _bound(value: Column, f) -> Column:
    """f(value), with value computed once: a lambda's argument isn't copied into each of its uses."""
    return F.get(F.transform(F.array(value), f), 0)


def chapter_number(line: Column) -> Column:
    """The number of a chapter heading, with or without a markup prefix; null for other lines.

    A line is cut into its fields once; each family of headings then states what its fields must be: a chapter's word with
    digits or a Roman numeral and a title, a Roman numeral alone with a title, Han, Thai and Korean ordinals.
    """
    fields = F.struct(line.alias("line"), *(F.regexp_extract(line, _FIELDS, g).alias(name) for g, name in enumerate(("mark", "opener", "sign", "rest"), 1)))
    return F.when(line.rlike(_FIELDS), _bound(fields, _number_of))


def _number_of(fields: Column) -> Column:
    line, mark, opener, sign, rest = (fields[name] for name in ("line", "mark", "opener", "sign", "rest"))
    marked = mark.startswith("#") & (F.length(line) <= LONGEST_HEADING)
    only = lambda signs, flags="": sign.rlike(f"^(?{flags or 'u'}:[{signs}]+)$")
    gap, tail = _led(rest)
    after = F.substring(tail, 2, LONGEST_HEADING)
    after_gap, after_tail = _led(after)

    # a title follows at once, after a sign, or begins as titles do: prose goes on in lower case
    titled = (tail == "") | _begins(tail, PARTING) | (gap & tail.rlike(f"^{TITLE_BEGINS}"))
    parted = lambda begins: _begins(tail, ROMAN_PARTING) & after_gap & after_tail.rlike(f"^{begins}")
    # Korean particles stand right at the noun, so a heading's noun stands free, after its branch number if it has one
    free_gap, free = _led(F.regexp_replace(after, rf"(?U)^\s*{KOREAN_BRANCH}\s*[0-9]+(?![0-9])", ""))
    stands_free = (free == "") | after_gap | free_gap | _begins(free, KOREAN_PARTING)

    word, thai = opener.rlike(rf"(?iU)^(?:{_CHAPTER})$"), opener.isin(*THAI_WORDS)
    value = (
        F.when(word & titled & sign.rlike("^[0-9]{1,2}$"), sign.try_cast("int"))
        .when(word & titled & only(ROMAN_SIGNS, "i") & (F.length(sign) <= 7), _roman_value(sign))
        .when((opener == "") & only(ROMAN_SIGNS) & parted(TITLE_BEGINS), _roman_value(sign))
        .when((opener == "") & marked & only(ROMAN_SIGNS.lower()) & parted(MARKED_TITLE_BEGINS), _roman_value(sign))
        .when((opener == HAN_ORDINAL) & only(f"0-9{WIDE_DIGITS}{_HAN}") & _begins(tail, HAN_CHAPTERS), _han_value(sign))
        .when(opener.isin("", HAN_ORDINAL) & marked & only(f"{WIDE_DIGITS}{_HAN}") & _begins(tail, HAN_PARTING + HAN_CHAPTERS), _han_value(sign))
        .when(thai & only(f"0-9{THAI_DIGITS}") & ~rest.rlike(r"(?U)^\w"), F.translate(sign, THAI_DIGITS, "0123456789").try_cast("int"))
        .when((opener == KOREAN_ORDINAL) & only("0-9") & _begins(tail, KOREAN_CHAPTERS) & stands_free, sign.try_cast("int"))
    )
    return F.when(F.length(line) - F.when(mark == "", 0).otherwise(F.length(mark) + 1) <= LONGEST_HEADING, value)


def has_contents(text: Column) -> Column:
    """Whether a line of its own heads a table of contents early in the text."""
    return F.substring(F.coalesce(text, F.lit("")), 1, CONTENTS_WITHIN).rlike(rf"(?imU)^\s*(?:{'|'.join((*CONTENTS, CONTENTS_HAN))})\s*$")


class Heading(NamedTuple):
    line: int
    depth: int
    title: str
    #: whether only its company tells if it is a chapter: a marked title that begins with a digit
    numbered: bool


#: A block from a fence to the next fence of its character; without one, all that remains.
_BLOCK = re.compile(r"([`~])((?:(?!\1).)*)(\1?)", re.DOTALL)


def _kind(line: str) -> str:
    """One letter for a stripped line: ` ~ a fence, = - a rule, # a marked title, . blank, a any other."""
    first = line[:1]
    if not first:
        return "."
    run = len(line) - len(line.lstrip(first))
    if first in "`~" and run >= 3:
        return first
    if first in "=-" and run == len(line) >= 2:
        return first
    return "#" if first in "#=" and run <= 6 and line[run : run + 1].isspace() else "a"


def line_kinds(lines: list[str]) -> str:
    """The kinds of stripped lines as one string; closed code blocks are x, and a fence that nothing closes is a plain line."""
    plain = str.maketrans("`~", "aa")
    return _BLOCK.sub(lambda m: "x" * len(m[0]) if m[3] else m[0].translate(plain), "".join(map(_kind, lines)))


def headings(lines: list[str]) -> list[Heading]:
    """Marked titles that hold a word, and plain lines over a rule at least as long as they, in order of lines."""
    found = []
    for m in re.finditer(r"#|(?<=a)[=-]", line_kinds(lines)):
        i, line = m.start(), lines[m.start()]
        if m[0] != "#":
            if len(line) >= len(lines[i - 1]):
                found.append(Heading(i, "=-".index(m[0]) + 1, lines[i - 1].lower(), False))
            continue
        bare = line.lstrip(line[0])
        title = bare.strip().rstrip("#").strip().lower()
        if re.search(r"\w", title):
            found.append(Heading(i, len(line) - len(bare), title, title[0].isdigit()))
    return found


def markup_chapters(text: str | None) -> int:
    """Distinct titles at the shallowest heading depth that has two, else all titles.

    Marked titles that begin with a digit count at a depth only if three or more stand there and half of them have a body of 200 characters.
    """
    raw = (text or "").splitlines()
    found = headings([x.strip() for x in raw])
    upto = [0, *accumulate(map(len, raw))]
    ends = [h.line for h in found[1:]] + [len(raw)]
    body = [upto[end] - upto[h.line + 1] for h, end in zip(found, ends, strict=True)] if found else []
    counts = []
    for depth in sorted({h.depth for h in found}):
        long = [b for h, b in zip(found, body, strict=True) if h.depth == depth and h.numbered]
        trusted = len(long) >= FEWEST_NUMBERED and median(long) >= SHORTEST_BODY
        counts.append(len({h.title for h in found if h.depth == depth and (trusted or not h.numbered)}))
    return next((n for n in counts if n > 1), sum(counts))


def detect_structure(docs: DataFrame) -> DataFrame:
    """(id, chapters, method, sample, has_toc) of docs (id, text). Method: numeric, structural or none; null text has no chapter."""

    @F.pandas_udf("long")
    def by_markup(texts: pd.Series) -> pd.Series:
        return texts.map(markup_chapters)

    line = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    candidates = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), _LINE_END, -1), line), lambda x: x.rlike(_FIELDS))
    numbered = F.filter(F.transform(candidates, lambda x: F.struct(x.alias("heading"), chapter_number(x).alias("number"))), lambda h: h["number"].isNotNull())
    rows = docs.select("id", "text", numbered.alias("found")).withColumn("numeric", F.size(F.array_distinct(F.col("found.number"))).cast("long"))
    # texts with numbered chapters don't reach Python
    rows = rows.withColumn("markup", by_markup(F.when(F.col("numeric") == 0, F.col("text"))))
    return rows.select(
        "id",
        F.when(F.col("numeric") > 0, F.col("numeric")).otherwise(F.col("markup")).alias("chapters"),
        F.when(F.col("numeric") > 0, "numeric").when(F.col("markup") > 0, "structural").otherwise("none").alias("method"),
        F.slice(F.col("found.heading"), 1, SAMPLE).alias("sample"),
        has_contents(F.col("text")).alias("has_toc"),
    )


def missing_sections(text: Column, sections: tuple[str, ...] = PLAN_SECTIONS) -> Column:
    """Required sections that no heading of the text names, in order."""
    t = F.coalesce(text, F.lit(""))
    absent = (F.when(~t.rlike(rf"(?im)^#+\s*.*{re.escape(s)}"), F.lit(s)) for s in sections)
    return F.array_compact(F.array(*absent))
