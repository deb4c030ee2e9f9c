import datetime

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import assess
from lodestrata.sources import markdown as M


def test_markdown_blocks():
    page = "<html><head><title>t</title></head><body><nav>menu</nav><main><h2>A  b</h2><p>One <b>two</b> <i>three</i><p>four<br>five<script>if (a</p>b) x()</script></main><footer>f</footer></body></html>"
    assert M.html_markdown(page) == "## A b\n\nOne **two** _three_\n\nfour  \nfive"
    assert M.html_markdown("<body><ul><li>a<li>b<ol start=3><li>c</ol></ul><hr><pre>x\n  y</pre></body>") == "*   a\n*   b\n    \n    3.  c\n\n* * *\n\n    x\n      y".replace("    \n    3", "\n    3")
    assert M.html_markdown('<p><a href="/u">l</a> <img src="i" alt="p"> <code>a*b</code> 1*2_[x]') == r"[l](/u) ![p](i) `a*b` 1\*2\_\[x\]"
    assert M.html_markdown("<blockquote><p>a</p><p>b</p></blockquote>") == "> a\n>\n> b"
    assert M.html_markdown('<div>x</div><div class="big content">y</div>') == "y"
    assert M.html_markdown("<table><tr><td>a<td>b<tr><td>c</table>") == "a | b\n\nc"
    assert M.html_markdown(None) == M.html_markdown("") == M.html_markdown("<script>x</script>") == ""


def test_markdown_of_deep_pages_keeps_text():
    assert M.html_markdown("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert M.html_markdown("</p></div>text</b>") == "text"


def test_page_cut(spark):
    got = spark.createDataFrame([("a" * 40,), ("b" * 10,), (None,)], "t string").select(M.page_cut(F.col("t"), 10).alias("t")).collect()
    assert got[0].t == "a" * 10 + "\n\n(cut: 30 of 40 characters are missing, 75%)"
    assert (got[1].t, got[2].t) == ("b" * 10, None)


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "q", r, f"d{r}", "x" * (r % 4) if r != 3 else None) for r in range(1, 13)], "qid int, query string, rank int, id string, text string")
    score = lambda q, t: F.when(F.length(t) > 0, F.length(t))
    got = [(r.id, r.rerank_score) for r in assess.rerank(rows, score, 50).orderBy("rank").collect()]
    assert got == [("d7", 3), ("d2", 2), ("d6", 2), ("d10", 2), ("d1", 1), ("d5", 1), ("d9", 1), ("d3", None), ("d4", None), ("d8", None)]
    assert assess.rerank(rows, score, 2).count() == 2
    assert assess.rerank(rows, None).where("rerank_score IS NULL").count() == 12
    assert assess.rerank(rows.where("false"), score).count() == 0


def test_semantic_groups(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [("x", 1, "p", a), ("x", 2, "q", a), ("x", 3, "r", b), ("two", 1, "p", a), ("two", 2, "q", a), ("gap", 1, "p", a), ("gap", 2, "q", None), ("gap", 3, " ", a)]
    got = assess.semantic_groups(spark.createDataFrame(rows, "id string, pos int, text string, vector array<double>"))
    assert sorted((r.id, r.text) for r in got.collect()) == [("gap", "p"), ("gap", "q"), ("two", "p"), ("two", "q"), ("x", "p\n\nq"), ("x", "r")]


def test_scenario_scores(spark):
    found = spark.createDataFrame([(1, 1, "k/a.md", "Alpha beta retrieval", 0.9), (1, 2, "k/b.md", None, 0.5), (2, 1, "c", "else", 0.7), (4, 1, "d", "zzz", 0.4)], "qid int, rank int, file_path string, text string, score double")
    rows = [(1, ["alpha", "BETA"], "a.md", "Alpha retrieval plans", False), (2, ["x"], None, None, True), (3, ["x"], None, "", True), (4, ["x"], "no", "missing words", False), (5, None, None, None, False)]
    got = {r.qid: tuple(r)[1:] for r in assess.scenario_scores(spark.createDataFrame(rows, "qid int, expected_markers array<string>, expected_source string, ground_truth string, out_of_scope boolean"), found).collect()}
    assert got == {1: (5, 4, "NA"), 2: (2, None, "WARN"), 3: (5, None, "PASS"), 4: (1, 1, "NA"), 5: (3, 3, "NA")}


def test_density_vectors_names_and_cells(spark):
    got = assess.extraction_density(spark.createDataFrame([(1, "a\n\n \nb"), (2, ""), (3, None)], "id int, text string")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 6, 4, 0.5, True), (2, 0, 1, 1.0, False), (3, 0, 1, 1.0, False)]
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>").select(X.unit_vector(F.col("v")).alias("u")).collect()
    assert [r.u for r in unit] == [pytest.approx([0.6, 0.8]), [0.0, 0.0], None]
    names = spark.createDataFrame([("31.12.2024", "23.59.58 - My talk.json"), ("31.12.2024", "23.59.58.json"), ("x", "notes.json")], "d string, f string")
    got = names.select(X.saved_at(F.col("d"), F.col("f")).alias("at"), X.saved_title(F.col("f")).alias("t")).collect()
    assert [tuple(r) for r in got] == [(datetime.datetime(2024, 12, 31, 23, 59, 58), "My talk"), (datetime.datetime(2024, 12, 31, 23, 59, 58), ""), (None, "notes")]
    cells = spark.createDataFrame([("| a | b |",), ("a|",), ("",)], "s string").select(X.table_cells(F.col("s")).alias("c")).collect()
    assert [r.c for r in cells] == [["a", "b"], ["a"], [""]]


def test_languages_are_told_by_letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = assess.language_profiles(docs.where("doc_id % 2 = 0"))
    told = assess.identify_language(docs.select(F.col("doc_id").alias("id"), "text"), profiles)
    met = docs.where("doc_id % 2 = 1 AND length(text) > 60").join(told.withColumnRenamed("lang", "told"), F.col("doc_id") == F.col("id")).toPandas()
    assert len(met) > 300 and (met.lang == met.told).mean() > 0.95
    few = assess.identify_language(spark.createDataFrame([(1, None), (2, "12 !"), (3, "")], "id int, text string"), profiles)
    assert {(r.id, r.lang) for r in few.collect()} == {(1, None), (2, None), (3, None)}


def test_rubric_and_gate(spark):
    rows = [
        (1, "where does moisture settle", ["Moisture", "peat"], "bog.md", "moisture settles within layers", False, "en"), (2, "where does moisture settle", ["nothing"], "x.md", None, False, "en"),
        (3, "unknown things", None, None, None, True, None), (4, "unknown things", None, None, None, True, "en"), (5, "moisture", ["Moisture"], None, "moisture", False, None), (6, "moisture here", ["Moisture"], None, None, False, "fr"), (7, "moisture", [], None, None, False, "en"),
    ]
    scenarios = spark.createDataFrame(rows, "qid int, query string, expected_markers array<string>, expected_source string, ground_truth string, out_of_scope boolean, language string")
    results = spark.createDataFrame([(q, 1, "a/bog.md", "Moisture settles within peat layers", 0.9) for q in (1, 2, 4, 5, 6)], "qid int, rank int, file_path string, text string, score double")
    answers = spark.createDataFrame([(1, "moisture does settle where peat is"), (2, "something else"), (3, None), (4, "a guess"), (5, "Moisture"), (6, "here")], "qid int, answer string")
    languages = spark.createDataFrame([(q, "en") for q in (1, 2, 4, 5, 6)], "qid int, lang string")
    got = assess.rubric(scenarios, results, answers, languages)
    scores = {r.qid: (r.context_relevance, r.faithfulness, r.answer_relevance, r.language_naturalness, r.hallucination) for r in got.collect()}
    assert scores == {1: (5, 5, 5, 5, "NA"), 2: (1, 3, 1, 4, "NA"), 3: (5, None, 5, 4, "PASS"), 4: (2, None, 1, 4, "WARN"), 5: (5, 5, 5, 5, "NA"), 6: (5, 3, 3, 3, "NA"), 7: (3, 3, 1, 2, "NA")}
    gate = assess.rubric_gate(got).first()
    assert (gate.n, gate.outside, gate.handled) == (7, 2, 2) and gate.context_relevance == pytest.approx(26 / 7) and gate.faithfulness == pytest.approx(19 / 5) and gate.answer_relevance == 3 and gate.passed
    assert not assess.rubric_gate(got.where("qid IN (2, 6)")).first().passed
    good = assess.rubric_gate(got.where("qid IN (1, 5)")).first()
    assert good.passed and good.overall == 5 and assess.rubric_gate(got.limit(0)).first().passed is False
