import pytest
from pyspark.sql import functions as F

from lodestrata.operators import code, measure, structure

HEADINGS = {
    "Chapter 9": 9, "  Capítulo 31: La orilla": 31, "Capitulo 8 Costas": 8, "Chapter XVI. Harbours": 16, "Chapter 3 tells of winds": None, "Ch. 7 – Tides": 7, "Chapter 1987. Floods": None, "Kapitel 4 Öfen": 4,
    "CH VI": 6, "Chapter 12a": None, "Chapter dim": None, "IX: Lanterns": 9, "XL. The Ferry": 40, "VIIII. Wrong": None, "xi: the mill": None, "## xi. harvest": 11, "## Chapter 14": 14, "=== Chapter 2": 2,
    "第七章 山": 7, "第 28 回": 28, "第十九节": 19, "第三百零二章": 302, "第４６章": 46, "## 八 · 归途": 8, "## 第二讲": 2, "## 第五：河": 5, "## 6 Tools": None, "第七": None,
    "บทที่ 8": 8, "## ตอนที่ ๔๕": 45, "ภาค 2x": None, "제7장 바다": 7, "## 제2장 산과 들": 2, "제3장에서 말한다": None, "제8장의4 보칙": 8, "제8장의4는": None, "제9장": 9, "제9장.": 9,
    "": None, "Just some words.": None, "Chapter 1 " + "A" * 90: None, "# Chapter 1 " + "A" * 69: 1, "# Chapter 1 " + "A" * 71: None,
}


def test_chapter_numbers(spark):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(HEADINGS)], "i int, line string")
    trimmed = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    got = {r.line: r.n for r in rows.select("line", structure.chapter_number(trimmed).alias("n")).collect()}
    assert got == HEADINGS


def test_roman_round_trip():
    assert [structure.roman(n) for n in (1, 4, 9, 14, 40, 90, 199)] == ["I", "IV", "IX", "XIV", "XL", "XC", "CXCIX"]


@pytest.mark.parametrize(
    ("text", "n"),
    [
        (None, 0), ("", 0), ("plain\ntext", 0), ("# Book\n## One\n## Two\n## two\n", 2), ("# Only\n", 1), ("One\n===\ntext\nTwo\n-----\n", 2), ("text\n\n---\nmore", 0),
        ("```\n# a\n# b\n```\n# c\n# d\n", 2), ("```\n# a\n# b\n", 2), ("~~~\n# a\n```\n# b\n", 2), ("## 1. Step\nx\n## 2. Step\ny\n## 3. Step\nz\n", 0),
        ("```\n~~~\n# a\n~~~\n# b\n", 2), ("A\n==\n==\nB\n--\n", 2), ("# ###\n# x #\n# y##\n", 2), ("```\nx\n```\n===\n", 0),
        ("".join(f"## {i}. Part\n{'word ' * 60}\n" for i in range(1, 5)), 4), ("=====\n", 0), ("A long title\n==\n", 0),
    ],
)
def test_markup_chapters(text, n):
    assert structure.markup_chapters(text) == n


def test_detect_structure(spark):
    texts = ["Contents\nChapter 1\nChapter 2\n\nChapter 1\nbody\rChapter 2\nas Chapter 9 says", "# T\n## A\n## B", "nothing", None, "the contents of this", "目 次\n第一章\n第二章", "x " * 20_000 + "\ncontents\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.chapters, r.method, len(r.sample), r.has_toc) for r in structure.detect_structure(rows).collect()}
    assert got == {0: (2, "numeric", 4, True), 1: (2, "structural", 0, False), 2: (0, "none", 0, False), 3: (0, "none", 0, False), 4: (0, "none", 0, False), 5: (2, "numeric", 2, True), 6: (0, "none", 0, False)}
    assert structure.detect_structure(rows.where("id < 0")).count() == 0


def test_missing_sections(spark):
    text = "# Overall approach\n## 2. Open Questions\nVerification Plan\n### Proposed Changes"
    got = spark.createDataFrame([(text,), (None,)], "text string").select(structure.missing_sections(F.col("text")).alias("m")).collect()
    assert got[0].m == ["Important Notes", "Execution Phases", "Verification Plan"] and len(got[1].m) == 6


SOURCE = '''import os
from sys import path


@decorated
def first(a):
    def inner():
        return a
    return inner


class Box:
    size = 1

    async def öpen(self): return "é"; x = 1

    class Lid:
        def shut(self):
            pass


if True:
    def last(): pass
'''


def test_code_chunks():
    got = code.chunk_code(SOURCE, "a dir/m.py")
    assert [(c["tags"][1:], c["line_start"], c["line_end"]) for c in got] == [
        (["module"], 1, 2), (["function", "first"], 6, 9), (["class", "Box"], 12, 19), (["function", "öpen"], 15, 15), (["class", "Lid"], 17, 19), (["function", "shut"], 18, 19), (["function", "last"], 23, 23),
    ]
    assert got[0]["text"] == "import os\nfrom sys import path" and got[0]["id"] == "a_dir/m.py:1-1:module:header"
    assert got[3]["text"] == 'async def öpen(self): return "é"; x = 1'
    assert [h["title"] for h in got[5]["section_headers"]] == ["python", "Box", "Lid"]
    assert code.chunk_code("def broken(:\n", "m.py")[0]["text"] == "def broken(:"
    assert code.chunk_code("x = 1\n", "m.py")[0]["text"] == "x = 1"
    assert code.chunk_code("func main() {}\n", "m.go")[0]["text"] == "func main() {}"
    assert code.chunk_code(None, "m.py") == [] and code.chunk_code("", "m.py") == []


def test_chunk_sources_and_languages(spark):
    files = spark.createDataFrame([("m.py", None, None, None, SOURCE), ("n.md", None, "knowledge", "x", "# T\n\nbody"), (None, None, None, None, "x"), ("e.py", None, None, None, None)], "file_path string, language string, layer string, namespace string, text string")
    got = code.chunk_sources(files).groupBy("file_path", "layer").count().collect()
    assert sorted(map(tuple, got)) == [("m.py", "workspace", 7), ("n.md", "knowledge", 1)]
    paths = spark.createDataFrame([("a/b.PY",), ("c.h",), ("Makefile",), (".py",), (None,)], "p string")
    assert [r.x for r in paths.select(code.language(F.col("p")).alias("x")).collect()] == ["python", "cpp", None, None, None]
    heads = spark.createDataFrame([("js", "javascript", "const a = require('a')\nb()\n export default b"), ("x", None, "import a"), ("g", "go", None)], "i string, l string, s string")
    assert [r.x for r in heads.select(code.module_header(F.col("s"), F.col("l")).alias("x")).collect()] == ["const a = require('a')\n export default b", "", ""]


def test_tool_usage(spark):
    call = "array<struct<id:string,name:string,arguments:string>>"
    rows = [("assistant", None, "hi", [("c1", "grep", "abcdefgh"), (None, None, "x")]), ("tool", "grep", "one two three", None), ("tool", None, "lost", None), ("tool", "tree", None, None), ("user", None, "q", None)]
    got = measure.tool_usage(spark.createDataFrame(rows, f"role string, name string, text string, tool_calls {call}"), 1.0, 2.0).orderBy("tool").collect()
    assert [(r.tool, r.calls, r.tokens_in, r.tokens_out) for r in got] == [("grep", 1, 5, 18), ("tree", 0, 0, 0)]
    assert got[0].cost == pytest.approx((got[0].tokens_in + 2 * got[0].tokens_out) / 1e6)


def test_batches_of_pages_are_read_in_slices(spark):
    import pyarrow as pa

    from lodestrata.sources import markdown

    pages = [f"<body><p>page {i}</p></body>" if i % 50 else None for i in range(150)]
    want = [f"page {i}" if i % 50 else "" for i in range(150)]
    slices = [s.to_pylist() for s in markdown.in_slices(iter([pa.array(pages), pa.array([], pa.string())]))]
    assert max(map(len, slices)) == markdown.PAGES and sum(slices, []) == want
    rows = spark.createDataFrame([*enumerate(pages)], "page_id int, html string").coalesce(1)
    assert [r.markdown for r in markdown.markdown_column(rows).orderBy("page_id").collect()] == want
