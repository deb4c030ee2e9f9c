import random

from lodestrata.operators.layout import in_lines, pieces_of, read_pages

PAGES = "id string, page int, items array<struct<str:string,x:double,y:double,width:double,height:double>>"


def at(s, x, y, width=None, height=10.0):
    return s, float(x), float(y), 5.0 * len(s) if width is None else width, height


GRID = [at(f"{name}{row}", x, 700 - 12 * row) for row in range(4) for name, x in (("a", 10), ("b", 100), ("c", 200 + row % 2))]


def read(spark, *pages):
    """What each of some pages gives, in order."""
    rows = spark.createDataFrame([("d", i, list(p)) for i, p in enumerate(pages)], PAGES)
    return [(r.text, r.table) for r in read_pages(rows).orderBy("page").collect()]


def test_spaces_lines_and_paragraphs(spark):
    got = read(
        spark, [], [at("world", 40, 700), at("Hello", 10, 701)], [at("Hel", 10, 700), at("lo", 25, 700)],
        [at("two", 10, 688), at("one", 10, 700), at("three", 10, 640)], [at("  a ", 0, 5)],
    )
    assert [t for t, _ in got] == ["", "Hello world", "Hello", "one\ntwo\n\nthree", "a"] and all(table is None for _, table in got)


def test_tables(spark):
    prose = [at("word", 10, 700 - 12 * i) for i in range(9)]
    sparse = [*GRID[:3], *(at("x", 10, 600 - 12 * i) for i in range(5)), at("y", 100, 600)]
    got = read(spark, [*GRID, at("aside", 500, 700)], GRID[:5], prose, sparse, [*GRID, at("+", 15, 700)])
    assert got[0][1].split("\n")[:3] == ["| a0 | b0 | c0 |", "| --- | --- | --- |", "| a1 | b1 | c1 |"] and got[0][0] == "aside"
    assert [table for _, table in got[1:4]] == [None] * 3 and got[2][0] == "\n".join(["word"] * 9)
    assert got[4][1].startswith("| a0+ | b0 | c0 |")  # two pieces of one cell


def test_no_piece_is_lost(spark):
    r = random.Random(7)
    pages = [[at("".join(r.choice("ab ") for _ in range(r.randrange(4))), 20 * r.randrange(16), 15 * r.randrange(12)) for _ in range(r.randrange(40))] for _ in range(60)]
    pages += [[*GRID, *(at("ab", 400 + 30 * k, 700 - 12 * k) for k in range(r.randrange(4)))] for _ in range(5)]
    got = read(spark, *pages)
    for page, (text, table) in zip(pages, got, strict=True):
        shown = text + (table or "")
        assert all(shown.count(c) == sum(p[0].count(c) for p in page) for c in "ab")
    assert any(table for _, table in got)


def test_lines_fall_by_the_upper_median_height(spark):
    pages = [("d", 1, [at("a", 0, 100, height=4.0), at("b", 9, 97, height=8.0)]), ("d", 2, [at("a", 0, 100, height=4.0), at("b", 9, 95, height=8.0)]), ("d", 3, [at("a", 0, 9, height=0.0), at("b", 0, 3, height=0.0)])]
    got = {(r.page, r["str"]): r.line for r in in_lines(pieces_of(spark.createDataFrame(pages, PAGES))).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 1, (2, "a"): 1, (2, "b"): 2, (3, "a"): 1, (3, "b"): 2}


def test_pages(spark):
    rows = spark.createDataFrame([("d", 1, GRID), ("d", 2, [("only", 1.0, None, None, None), (None, 1.0, 1.0, 1.0, 1.0), None]), ("e", 1, None), ("e", 2, []), (None, None, [at("x", 1, float("nan"))])], PAGES)
    got = {(r.id, r.page): (r.text, r.table is not None) for r in read_pages(rows).collect()}
    assert got == {("d", 1): ("", True), ("d", 2): ("only", False), ("e", 1): ("", False), ("e", 2): ("", False), (None, None): ("x", False)}
    assert read_pages(rows.limit(0)).count() == 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_pieces_are_never_shuffled(spark):
    rows = spark.createDataFrame([("d", 1, GRID), ("d", 2, [at("x", 1, 1)])], PAGES)
    assert exchanges(read_pages(rows)) == 1 and exchanges(read_pages(rows, whole=True)) == 0
    assert sorted(read_pages(rows).collect()) == sorted(read_pages(rows, whole=True).collect())
    parts = spark.createDataFrame([("d", 1, GRID[:5]), ("d", 1, None), ("d", 1, GRID[5:])], PAGES)
    assert [r.table for r in read_pages(parts).collect()] == [r.table for r in read_pages(rows.where("page = 1")).collect()] != [None]
