import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import search
from lodestrata.sources import files, layers
from lodestrata.streaming import live_index

DOC = "id string, text string"


def rows_of(index):
    return sorted((r.id, r.term, r.tf, r.dl) for r in index.postings.collect()), sorted((r.term, r.df) for r in index.terms.collect()), index.n, index.avgdl


def test_index_equals_one_built_anew(spark, tmp_path):
    """Random batches of changes and removals against an index of what is left, after each of them and after compaction."""
    r = random.Random(1)
    words = [f"word{i}" for i in range(20)] + ["the", "x"]
    index, alive, schema = live_index.LiveIndex(spark, str(tmp_path / "i"), buckets=4), {}, DOC
    for step in range(4):
        changes = {f"d{r.randrange(12)}": " ".join(r.choice(words) for _ in range(r.randrange(0, 9))) for _ in range(6)}
        removed = [f"d{r.randrange(14)}" for _ in range(3)] if step else []
        alive |= changes
        alive = {k: v for k, v in alive.items() if k not in removed}
        index.apply(spark.createDataFrame([*changes.items(), (None, "no id")], schema), spark.createDataFrame([(x,) for x in removed], "id string") if step else None)
        whole = search.build_index(spark.createDataFrame([*alive.items()], schema))
        got, want = rows_of(index.index()), rows_of(whole)
        assert got[:3] == want[:3] and got[3] == pytest.approx(want[3])
        assert {d.id for d in index.documents().collect()} == set(alive)
        whole.release()
    before = rows_of(index.index())
    index.compact()
    index.vacuum()
    assert rows_of(index.index()) == before and index.version().ended == [] and files.names(spark, str(tmp_path / "i" / "docs")) == [f"epoch={index.version().number}"]
    status = index.status()
    assert status["documents"] == len(alive) and status["bytes"] > 0 and status["last_write"] > 0 and status["epochs"] == 1


def test_unchanged_content_and_repeated_batches_write_nothing(spark, tmp_path):
    index = live_index.LiveIndex(spark, str(tmp_path), buckets=2)
    docs = spark.createDataFrame([("a", "red fox"), ("b", None), ("b", "blue"), ("b", "blue")], DOC)
    one = index.apply(docs, batch=0)
    assert one.n == 2 and index.apply(docs) == one and index.apply(docs.where("id = 'q'"), docs.where("id = 'zz'").select("id")) == one
    again = index.apply(docs, batch=1)
    assert again.epochs == one.epochs and again.batch == 1 and files.names(spark, f"{tmp_path}/docs") == [f"epoch={one.epochs[0]}"]
    assert index.apply(spark.createDataFrame([("a", "other")], DOC), batch=1) == again
    empty = live_index.LiveIndex(spark, str(tmp_path / "none"))
    assert empty.index().n == 0 and empty.apply(docs.limit(0)).n == 0 and empty.index().postings.count() == 0 and empty.apply(docs).n == 2


def test_a_halted_save_leaves_the_version_before(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    index = live_index.LiveIndex(spark, root, buckets=2)
    index.apply(spark.createDataFrame([("a", "red fox"), ("b", "red")], DOC))
    old = rows_of(index.index())
    change, gone = spark.createDataFrame([("a", "green fox"), ("c", "fox")], DOC), spark.createDataFrame([("b",)], "id string")
    put = files.put_text
    monkeypatch.setattr(files, "put_text", lambda *a: (_ for _ in ()).throw(OSError("halted")))
    with pytest.raises(OSError, match="halted"):
        index.apply(change, gone)
    assert rows_of(live_index.LiveIndex(spark, root).index()) == old
    monkeypatch.setattr(files, "put_text", lambda s, path, text: put(s, path, text[: len(text) // 2]))
    index.apply(change, gone)  # the version's file is damaged: it doesn't count
    assert rows_of(live_index.LiveIndex(spark, root).index()) == old
    monkeypatch.setattr(files, "put_text", put)
    index.apply(change, gone)
    assert {(i, t) for i, t, _, _ in rows_of(live_index.LiveIndex(spark, root).index())[0]} == {("a", "green"), ("a", "fox"), ("c", "fox")}
    with pytest.raises(FileExistsError):
        files.put_text(spark, f"{root}/versions/{index.version().number:09d}.json", "")


def test_terms_of_few_queries_reach_the_scan(spark, tmp_path, monkeypatch):
    index = live_index.LiveIndex(spark, str(tmp_path), buckets=4)
    index.apply(spark.createDataFrame([(f"d{i}", f"common term{i} term{i % 7}") for i in range(60)], DOC))
    queries = spark.createDataFrame([(1, "common term3"), (2, "term5")], "qid int, query string")
    narrow = index.index(queries)
    plan = narrow.postings._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan and "PartitionFilters: [bucket" in plan.replace("#", " ").replace("isnotnull", "") or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert {r.term for r in narrow.postings.select("term").distinct().collect()} == {"common", "term3", "term5"}
    want = sorted(map(tuple, search.bm25(queries, index.index()).collect()))
    assert sorted(map(tuple, search.bm25(queries, narrow).collect())) == want
    monkeypatch.setattr(live_index, "PUSHED_TERMS", 1)
    assert sorted(map(tuple, search.bm25(queries, index.index(queries)).collect())) == want
    monkeypatch.setattr(live_index, "SMALL_GONE", 0)
    index.apply(spark.createDataFrame([("d3", "other")], DOC))
    assert "d3" not in {r.id for r in search.bm25(queries, index.index(queries), 0).collect()}


def test_layers_are_walked_and_synced(spark, tmp_path):
    """Two roots with their own rules; a second walk finds what changed and what is gone."""
    for path, text in {"k/a.md": "alpha", "k/sub/b.txt": "beta", "k/sub/c.exe": "x", "k/node_modules/d.md": "x", "k/drafts/e.md": "x", "k/plain": "no extension", "w/a.md": "other alpha", "w/drafts/f.md": "kept"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "k" / ".ragignore").write_text("# mine\n\ndrafts/\n")
    roots = {"knowledge": str(tmp_path / "k"), "workspace": str(tmp_path / "w")}
    walk = lambda content=True: layers.layer_files(spark, roots, content)
    got = {(r.layer, r.path, r.namespace, r.name, r.length) for r in walk(False).collect()}
    assert got == {("knowledge", "a.md", "", "a.md", 5), ("knowledge", "sub/b.txt", "sub", "b.txt", 4), ("knowledge", "plain", "", "plain", 12), ("workspace", "a.md", "", "a.md", 11), ("workspace", "drafts/f.md", "drafts", "f.md", 4)}
    assert {r.path: r.file_hash for r in walk().where("layer = 'knowledge'").collect()}["a.md"] == hashlib.sha256(b"alpha").hexdigest()
    live = lambda: walk().select(F.concat_ws(":", "layer", "path").alias("id"), F.decode("content", "UTF-8").alias("text"))
    index = live_index.LiveIndex(spark, str(tmp_path / "i"), buckets=2)
    one = index.sync(live())
    assert one.n == 5 and index.sync(live()) == one
    (tmp_path / "k" / "a.md").write_text("gamma")
    (tmp_path / "w" / "a.md").unlink()
    (tmp_path / "w" / "new.md").write_text("delta")
    two = index.sync(live())
    assert two.n == 5 and two.n_gone == 2 and two.epochs == [*one.epochs, two.number]
    assert {(r.id, r.term) for r in index.index().postings.collect()} >= {("knowledge:a.md", "gamma"), ("workspace:new.md", "delta")}
    listed = layers.resolve_inputs(spark, [str(tmp_path / "w" / "new.md"), str(tmp_path / "*" / "*.md"), str(tmp_path / "k")]).orderBy("place").collect()
    assert [r.path.split("/", 3)[-1].split("/")[-2:] for r in listed][0] == ["w", "new.md"] and len(listed) == len({r.path for r in listed}) and not any(r.path.endswith(("exe", "plain")) for r in listed)
    assert layers.resolve_inputs(spark, []).count() == 0


def test_stream_keeps_the_index(spark, tmp_path):
    events, root = str(tmp_path / "e"), str(tmp_path / "i")
    rows = [("a/x", "add", 1), ("a/y", "add", 1), ("b", "add", 2), ("a", "unlinkDir", 3), ("a/z", "add", 3), ("b", "unlink", 4), ("c", "change", 5)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "path string, last_kind string, n int").withColumn("last_ts", F.timestamp_seconds("n")).write.parquet(f"{events}/{i}")
    texts = spark.createDataFrame([(p, f"text of {p}") for p in ("a/x", "a/y", "a/z", "b", "c")], "path string, text string")

    def text_of(paths):
        return paths.join(texts, "path").select(F.col("path").alias("id"), "text")

    for most in (2, 4, None):  # ended and started again from its checkpoint
        stream = spark.readStream.schema("path string, last_kind string, n int, last_ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(events)
        query = live_index.LiveIndex(spark, root, buckets=2).follow(stream, text_of, str(tmp_path / "c"), available_now=most is None)
        if most is None:
            query.awaitTermination(200)
        else:
            while query.lastProgress is None or query.lastProgress["batchId"] < most - 1:
                query.awaitTermination(1)
            query.stop()
        assert query.exception() is None
    index = live_index.LiveIndex(spark, root)
    assert {d.id for d in index.documents().collect()} == {"a/z", "c"} and index.version().n == 2


def test_an_epoch_shuffles_texts_once_and_counts_terms_in_their_rows(spark, tmp_path):
    index = live_index.LiveIndex(spark, str(tmp_path), buckets=2)
    words = ["b", "bb", "aa", "bb", "the", "cc", "aa", "bb"]
    docs = spark.createDataFrame([("a", "h", " ".join(words)), ("e", "h", ""), ("s", "h", "the")], "id string, hash string, text string")
    got = index._analysed(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.id: (r.dl, [tuple(t) for t in r.terms]) for r in got.collect()} == {"a": (6, [("aa", 2), ("bb", 3), ("cc", 1)]), "e": (0, []), "s": (0, [])}


def test_postings_are_written_where_documents_are_read(spark, tmp_path, monkeypatch):
    """No shuffle of postings in epochs or compaction, files sorted by term, texts dealt by their bytes."""
    import pyarrow.parquet as pq

    plans, write = [], live_index.LiveIndex._write_postings
    monkeypatch.setattr(live_index.LiveIndex, "_write_postings", lambda self, number, postings: plans.append(postings._jdf.queryExecution().executedPlan().toString()) or write(self, number, postings))
    monkeypatch.setattr(live_index, "FILES", 1 << 12)
    index = live_index.LiveIndex(spark, str(tmp_path), buckets=3)
    docs = spark.createDataFrame([(f"d{i}", f"term{i % 5} common word{i}") for i in range(300)], DOC)
    index.apply(docs)
    index.apply(docs.where("id < 'd2'").withColumn("text", F.concat("text", F.lit(" more"))), docs.where("id > 'd9'").select("id"))
    before = rows_of(index.index())
    index.compact()
    index.vacuum()
    assert rows_of(index.index()) == before and [p.count("Exchange hashpartitioning") for p in plans] == [0, 0, 1]  # compaction's is that of tombstones
    found = sorted(tmp_path.glob("postings/epoch=*/bucket=*/*.parquet"))
    assert {f.parent.name for f in found} == {"bucket=0", "bucket=1", "bucket=2"} and len(found) > 3  # of several tasks
    for f in found:
        rows = pq.ParquetFile(f).read(columns=["term", "id"]).to_pylist()
        assert rows == sorted(rows, key=lambda r: (r["term"], r["id"]))
    texts = lambda n, size: spark.range(n).select(F.repeat(F.lit("x"), F.lit(size)).alias("text"))
    assert [search.tasks(texts(n, 1000), 1 << 15) for n in (0, 1, 4000, 8000)] == [1, 1, 123, 245]
