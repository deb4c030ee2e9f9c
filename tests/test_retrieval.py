import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import chunk, corpus, measure, search
from lodestrata.sources import extract
from lodestrata.streaming import maintain


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, X.tokens(F.lit("Seven GREY-geese; crossed at 19"), False)) == ["seven", "grey", "geese", "crossed", "at", "19"]
    assert one(spark, X.tokens(F.lit("the harbour and a lantern"))) == ["harbour", "lantern"]
    assert one(spark, X.tokens(F.lit(None).cast("string"))) == []


def test_expansion_and_rewriting(spark):
    assert one(spark, X.expand_query(F.lit("tides and lanterns"))) == ["tides and lanterns", "tides", "lanterns"]
    assert one(spark, X.expand_query(F.lit("ferries or bridges"))) == ["ferries or bridges", "ferries", "bridges"]
    assert one(spark, X.rewrite_query(F.lit("quiet harbour"))) == "quiet harbour"
    assert "endpoint" in one(spark, X.rewrite_query(F.lit("api")))


def test_token_estimates(spark):
    assert one(spark, X.budget_tokens(F.lit("a" * 16))) == 4
    assert one(spark, X.budget_tokens(F.lit("a" * 17))) == 5
    assert one(spark, X.budget_tokens(F.lit("ships 海港 winds"))) == 4
    assert one(spark, X.sanitize(F.lit("a​b\U000e0041c"))) == "abc"


def test_bm25_prefers_short_and_frequent(spark):
    docs = spark.createDataFrame([("a", "lantern lantern lantern oil"), ("b", "lantern " + "slow tides " * 20), ("c", None), (None, "lantern")], "id string, text string")
    index = search.build_index(docs)
    got = search.bm25(spark.createDataFrame([(1, "lantern")], "qid long, query string"), index).orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "b"] and index.n == 3


def test_snapshot(spark, tmp_path):
    docs = spark.createDataFrame([("a", "ferry dock"), ("b", "bridge")], "id string, text string")
    search.build_index(docs).save(str(tmp_path / "i"))
    again = search.Index.load(spark, str(tmp_path / "i"))
    assert search.bm25(spark.createDataFrame([(1, "bridge")], "qid long, query string"), again).first().id == "b"
    assert search.Index.load(spark, str(tmp_path / "none")) is None


def test_rrf_and_budget(spark):
    lists = [spark.createDataFrame(rows, "qid long, id string, rank int") for rows in ([(1, "a", 1), (1, "b", 2)], [(1, "b", 1), (1, "c", 2)])]
    got = {r.id: r.rrf for r in search.rrf(lists, 60).collect()}
    assert got["b"] > got["a"] > 0 and got["c"] > 0
    rows = spark.createDataFrame([(1, 1, 50), (1, 2, 50), (1, 3, 50), (2, 1, 2000), (2, 2, 40)], "qid long, rank int, tokens long")
    kept = {(r.qid, r["rank"]) for r in search.within_budget(rows, 160).collect()}
    assert kept == {(1, 1), (1, 2), (2, 1)}


def test_cosine(spark):
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    assert one(spark, search.cosine(v(1, 0), v(1, 0))) == pytest.approx(1)
    assert one(spark, search.cosine(v(1, 0), v(0, 1))) == 0
    assert one(spark, search.cosine(v(1, 0), v(1, 0, 0))) == 0


def test_hybrid_scores_of_missing_sides(spark):
    sparse = spark.createDataFrame([(1, "k", 3.0, 1)], "qid long, id string, score double, rank int")
    found = spark.createDataFrame([(1, "d", 0.4, 1)], "qid long, id string, score double, rank int")
    got = {r.id: r.score for r in search.hybrid(sparse, found).collect()}
    assert got["d"] == pytest.approx(0.4) and got["k"] == pytest.approx(0.75)


def test_retrieve_retries_once(spark):
    docs = spark.createDataFrame([("a", "endpoint interface"), ("b", "unrelated")], "id string, text string")
    index = search.build_index(docs)
    got = search.retrieve(spark.createDataFrame([(1, "api")], "qid long, query string"), lambda q: search.bm25(q, index), min_score=0.01).collect()
    assert [(r.id, r.iterations) for r in got] == [("a", 2)]


def test_merged_subqueries(spark):
    docs = spark.createDataFrame([("a", "red"), ("b", "blue"), ("c", "green")], "id string, text string")
    index = search.build_index(docs)
    got = search.merged_subqueries(spark.createDataFrame([(1, "red and blue")], "qid long, query string"), lambda q: search.bm25(q, index))
    assert {r.id for r in got.collect()} == {"a", "b"}


def test_grep_and_lines(spark):
    docs = spark.createDataFrame([("a.txt", "apple\nbanana\r\ncherry\nbanana"), ("b.txt", "fig")], "id string, text string")
    got = corpus.grep(docs, "banana", context=1, limit=0).collect()
    assert [(r.line_number, r.context) for r in got] == [(2, "apple\nbanana\ncherry"), (4, "cherry\nbanana")]
    assert [r.shown for r in corpus.line_range(docs, 2, 2).collect()] == ["     2|banana"]
    assert one(spark, corpus.line_of_offset(F.lit("ab\ncd\nef"), F.lit(3))) == 2


def test_indexable(spark):
    paths = ["a/.env", "src/x.py", "node_modules/q/r.js", "notes.md", "x.exe", "Makefile", "a/my.secret.md", "a/keep.secret.md"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").where(corpus.indexable(F.col("p"), ["*.secret.md", "!keep.secret.md", "# no"])).collect()
    assert [r.p for r in got] == ["src/x.py", "notes.md", "Makefile", "a/keep.secret.md"]


def test_page_cleanup(spark):
    pages = [("d", i, f"HEAD\nbody {w}\n{i}") for i, w in enumerate(("one", "two", "three", "hyphen-"), 1)]
    got = corpus.page_cleanup(spark.createDataFrame(pages, "id string, page int, text string")).first().text
    assert got == "body one\nbody two\nbody three\nbody hyphen-"


def test_chunks_cover_lines_and_overlap():
    para = lambda s: " ".join([s] * 70)
    text = f"# Top\n\n{para('alpha beta')}\n\n{para('gamma delta')}\n\n## Sub #tag\n\n[box] text"
    got = chunk.chunk_text(text, "f.md")
    assert [c["line_start"] for c in got] == [3, 5, 9]
    assert got[0]["text"].startswith("# Top\n\nalpha") and got[1]["text"].startswith(para("alpha beta")[-120:].strip())
    assert got[2]["section_headers"] == [{"level": 1, "title": "Top"}, {"level": None, "title": "Sub #tag"}] and "box" in got[2]["tags"]
    assert chunk.chunk_text("  ", "f") == [] and chunk.chunk_text(None, "f") == []


def test_html_rtf_decode():
    html = "<html><head><title>t</title></head><body><style>x</style><h2>Chapter 1</h2>\n<p>Intro</p><table><tr><td>A</td> <td>B</td></tr></table></body></html>"
    assert extract.html_text(html) == "Chapter 1\nIntro\nA\tB"
    assert extract.rtf_text(r"{\rtf1{\fonttbl{\f0 X;}}{\info hidden}caf\u233?\par next}") == "café\nnext"
    assert extract.decoded("ä".encode("utf-16")) == "ä" and extract.decoded(b"\xe4") == "ä"


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_docx_and_errors(spark):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {ns}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    good, bad = _zip(**{"word__document.xml": body}), _zip(**{"word__document.xml": "<!DOCTYPE x>" + body})
    got = {r.path: r for r in extract.extract_files(spark.createDataFrame([("a.docx", bytearray(good)), ("b.docx", bytearray(bad)), ("c.txt", bytearray(b"t"))], "path string, content binary")).collect()}
    assert got["a.docx"].text == "Hello\nA\tB" and got["b.docx"].text is None and "refused" in got["b.docx"].error and got["c.txt"].text == "t"


def test_epub_spine_order():
    opf = '<package><manifest><item id="a" href="one.xhtml" media-type="application/xhtml+xml"/><item id="b" href="two.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>'
    data = _zip(**{"c.opf": opf, "one.xhtml": "<body><p>first</p></body>", "two.xhtml": "<body><p>second</p></body>"})
    assert extract.epub_text(data) == "second\n\nfirst"


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 00:00:00', 'p', 'add'), (timestamp'2024-01-01 00:00:00.3', 'p', 'change'), (timestamp'2024-01-01 00:01:00', 'p', 'unlink'), (timestamp'2024-01-01 01:00:00', 'z', 'add') AS t(ts, path, kind)")
    rows.write.parquet(str(tmp_path / "in"))
    batch = maintain.debounce(rows, "700 milliseconds").where("path = 'p'").collect()
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = maintain.debounce(stream.withWatermark("ts", "10 seconds"), "700 milliseconds").writeStream.outputMode("append").format("memory").queryName("bounced").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.path, r.n_events, r.last_kind) for r in batch} == {(r.path, r.n_events, r.last_kind) for r in spark.table("bounced").collect() if r.path == "p"} == {("p", 2, "change"), ("p", 1, "unlink")}


def test_apply_events(spark):
    s = "file_path string, text string"
    store = spark.createDataFrame([("a", "old"), ("b", "stay"), ("d/x", "gone")], s)
    events = spark.createDataFrame([("a", "change"), ("d", "unlinkDir")], "path string, last_kind string")
    got = maintain.apply_events(store, events, spark.createDataFrame([("a", "new"), ("q", "no")], s)).collect()
    assert {tuple(r) for r in got} == {("a", "new"), ("b", "stay")}


def test_store_of_epochs(spark, tmp_path):
    kinds, s = "path string, last_kind string", "file_path string, text string"
    root = str(tmp_path / "store")
    step = lambda epoch, events, chunks: maintain.write_epoch(root, epoch, spark.createDataFrame(events, kinds), spark.createDataFrame(chunks, s))
    alive = lambda where=root: {tuple(r) for r in maintain.read_store(spark, where).collect()}
    step(0, [("a", "add"), ("d/x", "add"), ("d/e/y", "add"), ("dd/z", "add")], [("a", "1"), ("a", "2"), ("d/x", "3"), ("d/e/y", "4"), ("dd/z", "5"), ("other", "no")])
    assert len(alive()) == 5
    step(1, [("a", "change"), ("d", "unlinkDir")], [("a", "6")])
    assert alive() == {("a", "6"), ("dd/z", "5")}
    step(2, [("d/x", "add"), ("a", "unlink")], [("d/x", "7")])
    assert alive() == {("d/x", "7"), ("dd/z", "5")}
    step(2, [("d/x", "add"), ("a", "unlink")], [("d/x", "7")])
    assert alive() == {("d/x", "7"), ("dd/z", "5")}
    maintain.compact(spark, root, str(tmp_path / "small"))
    assert alive(str(tmp_path / "small")) == alive()


def test_maintain_streams_into_the_store(spark, tmp_path):
    s = "path string, ts timestamp, kind string"
    rows = [("a", "2024-01-01 00:00:00", "add"), ("b/c", "2024-01-01 00:00:01", "add"), ("b", "2024-01-01 00:01:00", "unlinkDir"), ("z", "2024-01-01 01:00:00", "add")]
    events, root = str(tmp_path / "events"), str(tmp_path / "store")
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "path string, ts string, kind string").selectExpr("path", "CAST(ts AS TIMESTAMP) AS ts", "kind").write.parquet(f"{events}/{i}")
    stream = spark.readStream.schema(s).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(events)
    chunks = lambda paths: paths.selectExpr("path AS file_path", "concat('text of ', path) AS text")
    q = maintain.maintain(stream, root, chunks, str(tmp_path / "c"), available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None
    assert {tuple(r) for r in maintain.read_store(spark, root).collect()} == {("a", "text of a")}


def test_search_arguments(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red fox red"), (3, "blue whale")], "id long, text string")
    about = spark.createDataFrame([(1, "l", "n", 5), (2, "m", "n", 90), (3, "l", "o", 5)], "id long, layer string, namespace string, tokens long")
    q = spark.createDataFrame([(7, "red fox", [1.0, 0.0])], "qid long, query string, qv array<double>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "id long, v array<double>")
    index = search.build_index(docs)
    ids = lambda **k: [(r.id, r.rank, r.truncated) for r in search.search(q, index=index, vectors=vectors, about=about, **k).orderBy("rank").collect()]
    assert ids(mode="keyword", layer="m") == [(2, 1, 0)]
    assert ids(mode="dense", min_score=0.5) == [(1, 1, 0), (2, 2, 0)]
    assert [i for i, _, _ in ids(namespace="n")] == [1, 2]
    assert ids(mode="dense", max_tokens=50) == [(1, 1, 1), (3, 2, 1)]
    assert [i for i, _, _ in ids(mode="keyword", expand=True, top_k=1)] == [i for i, _, _ in ids(mode="keyword", top_k=1)]
    with pytest.raises(ValueError, match="mode"):
        search.search(q, "other")


def test_history_word_is_literal(spark):
    m = spark.createDataFrame([(1, 0, "user", "what is C.x here"), (2, 0, "user", "what is Cyx here"), (3, 0, "system", "C.x")], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in measure.history_search(m, "c.x").collect()] == [1]


def test_queries_match_sql(spark):
    import duckdb

    import __spark_entry__

    root = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations events".split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    known = __spark_entry__.queries()
    for name, sql in __spark_entry__.oracle_sql().items():
        got, want = known[name](spark, root).toPandas(), db.sql(sql).df()
        assert len(got) == len(want), name
        columns = sorted(want.columns)
        assert set(columns) <= set(got.columns) if name.startswith("op") else set(columns) == set(got.columns), name
        rows = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
        for c in columns:
            if str(want[c].dtype) == "Int64":  # whole numbers with nulls, which Spark hands to pandas as floating point
                got[c] = got[c].astype("Int64")
            elif got[c].dtype.kind == "f":
                got[c], want[c] = got[c].round(6), want[c].round(6)
        assert rows(got) == rows(want), name


def test_budget_comes_before_the_cut(spark):
    """A result that doesn't fit is skipped and a later one moves up, past the number that is shown."""
    words = ["quartz " * (8 - i) + "filler " * i for i in range(8)]
    docs = spark.createDataFrame([(i, w, "docs", "n", f"a/{i}.md", i + 1) for i, w in enumerate(words)], "id int, text string, layer string, namespace string, file_path string, line_start int")
    about = docs.withColumn("tokens", F.when(F.col("id") == 1, 500).otherwise(10).cast("long"))
    queries = spark.createDataFrame([(1, "quartz")], "qid int, query string")
    index = search.build_index(docs)
    got = search.search(queries, "keyword", index=index, about=about, max_tokens=100).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 2, 3, 4, 5] and [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    # one didn't fit; that two more weren't shown isn't truncation
    assert {r.truncated for r in got} == {1} and got[1].file_path == "a/2.md" and got[1].line_start == 3 and got[1].text == words[2]
    index.release()


def test_search_without_vectors_and_with_a_scorer(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(["red apple pie", "green apple", "blue sky", "apple apple apple"])], "id int, text string, tokens long")
    vectors = spark.createDataFrame([(i, [float(i == k) for k in range(4)]) for i in range(4)], "id int, v array<double>")
    queries = spark.createDataFrame([(1, "apple and sky", [1.0, 0.0, 0.0, 0.0]), (1, "apple and sky", [0.0, 0.0, 1.0, 0.0]), (2, "apple", None)], "qid int, query string, qv array<double>")
    index = search.build_index(docs)
    plain = search.search(queries, index=index, vectors=vectors, about=docs, top_k=9).collect()
    assert {r.id for r in plain if r.qid == 2} == {0, 1, 3} and all(r.dense_score is None for r in plain if r.qid == 2)
    # each id keeps the best score of either vector, and of either part of the query
    assert {r.id: r.dense_score for r in plain if r.qid == 1} == {0: 1.0, 1: 0.0, 2: 1.0, 3: 0.0} and next(r.bm25_score for r in plain if (r.qid, r.id) == (1, 2)) > 0
    shortest = search.search(queries, index=index, vectors=vectors, about=docs, scorer=lambda q, t: -F.length(t)).orderBy("qid", "rank").collect()
    assert [r.id for r in shortest if r.qid == 2] == [1, 0, 3] and [r.rerank_score for r in shortest if r.qid == 2] == [-11.0, -13.0, -17.0]
    hashed = lambda c: F.transform(F.array(*map(F.lit, ("red", "green", "blue", "pie"))), lambda w: F.contains(c, w).cast("double"))
    own = docs.select("id", hashed(F.col("text")).alias("v"))
    embedded = search.search(spark.createDataFrame([(1, "red and blue")], "qid int, query string"), "dense", vectors=own, embed=hashed).collect()
    assert {r.id for r in embedded if r.score == 1} == {2} and all(r.dense_score > 0 for r in embedded if r.id in (0, 2))
    index.release()


def test_dense_blocks_give_every_row_of_the_plain_join(spark, monkeypatch):
    import math
    import random

    from lodestrata.operators import nearest

    for name, n in (("QUERIES", 7), ("VECTORS", 11), ("TILE", 40), ("PAIRS", 5)):
        monkeypatch.setattr(nearest, name, n)
    r = random.Random(3)
    vs = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(20)] * 3 + [[0.0] * 4] * 3 + [[1.0, 2.0], [], None, [1.0, None, 1.0, 1.0], [-1.0] * 4]
    rows = [(i, v, i % 3 if i % 17 else None) for i, v in enumerate(vs)]
    v = spark.createDataFrame(rows, "id int, v array<float>, label int")
    q = v.select(F.struct("id", F.lit("a").alias("part")).alias("qid"), F.col("v").alias("qv"), "label")
    for same in ([], ["label"]):
        pairs = q.join(v, same) if same else q.crossJoin(v.drop("label"))
        plain = pairs.select("qid", "id", search.cosine(F.col("qv"), F.col("v")).alias("score"))
        want = search.top(plain, ["qid"], 6, F.desc(F.round("score", 9)), F.asc("id"))
        key = lambda d: sorted((tuple(x.qid), x.id, x["rank"], x.score) for x in d.collect())
        got, want = key(search.dense(q, v, 6, same)), key(want)
        assert [x[:3] for x in got] == [x[:3] for x in want] and all(math.isclose(a[3], b[3], abs_tol=1e-15) for a, b in zip(got, want))
    assert "BroadcastNestedLoop" not in (plan := search.dense(q, v, 6)._jdf.queryExecution().executedPlan().toString()) and "FlatMapCoGroups" in plan
    assert search.dense(q.limit(0), v, 6).count() == search.dense(q, v.limit(0), 6).count() == 0


def test_an_index_for_few_queries_keeps_their_terms_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, None), (4, ""), (4, "grey the"), (5, "blue fox"), (5, "blue fox"), (None, "red")], "id int, text string")
    queries = spark.createDataFrame([(1, "red fox and green"), (2, "fox fox"), (3, "")], "qid int, query string")
    whole, own = search.build_index(docs), search.build_index(docs, queries=queries)
    assert {r.term for r in own.postings.collect()} == {"red", "fox"} and (own.n, own.avgdl) == (whole.n, whole.avgdl)
    ranked = lambda i: sorted(map(tuple, search.bm25(queries, i, 0).collect()))
    assert ranked(own) == ranked(whole) != []
    own.release()
    assert not own.kept.is_cached
    monkeypatch.setattr(search, "SMALL_QUERIES", 1)
    assert sorted(map(tuple, search.build_index(docs, queries=queries).postings.collect())) == sorted(map(tuple, whole.postings.collect()))
    none = search.build_index(docs.limit(0), queries=queries)
    assert (none.n, none.avgdl, none.postings.count()) == (0, 1.0, 0)


def test_an_index_of_more_text_has_more_parts(spark, monkeypatch):
    """Whatever the session's number of shuffle partitions; results don't depend on it."""
    docs = spark.range(400).select("id", F.concat(F.lit("red fox "), F.repeat(F.lit("filler "), F.lit(20)), F.lit("word"), F.col("id") % 7).alias("text"))
    queries = spark.createDataFrame([(1, "red word3"), (2, "fox")], "qid int, query string")
    found = []
    for most in (1 << 20, 1 << 12):
        monkeypatch.setattr(search, "TEXTS", most)
        index = search.build_index(docs, queries=queries)
        got = sorted((r.qid, r.rank, r.id, round(r.score, 9)) for r in search.bm25(queries, index, 20).collect())
        found.append((index.postings.rdd.getNumPartitions(), got))
        index.release()
    assert found[0][1] == found[1][1] and len(found[0][1]) == 40 and found[0][0] <= 4 and found[1][0] >= 400 * 150 // (1 << 12)
