import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.streaming import maintain, stateful


@pytest.fixture
def state(spark):
    stateful.keep_state(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def write_parts(frames, folder):
    for i, f in enumerate(frames):
        f.coalesce(1).write.parquet(f"{folder}/{i}")
        time.sleep(0.02)  # files are taken in the order of their times


def run_in_turns(stream, sink, where, turns=2):
    """Run a query to its end, stopping it after some batches and starting it again from its checkpoint."""
    for turn in range(turns):
        query = stream.writeStream.format("parquet").option("path", f"{where}/{sink}").option("checkpointLocation", f"{where}/c-{sink}").outputMode("append")
        query = (query.trigger(availableNow=True) if turn == turns - 1 else query).start()
        if turn == turns - 1:
            query.awaitTermination(300)
        else:
            while (query.lastProgress is None or query.lastProgress["batchId"] < 1) and query.isActive:
                query.awaitTermination(1)
            query.stop()
        assert query.exception() is None


def test_changed_content_stream_equals_batch(state, tmp_path):
    r, schema = random.Random(2), "layer string, path string, file_hash string, n int"
    rows = [(r.choice(["knowledge", "workspace"]), r.choice("abc"), r.choice(["h1", "h2", None]), n) for n in range(60)]
    every = state.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("n"))
    write_parts([every.where(F.col("n").between(15 * i, 15 * i + 14)) for i in range(4)], str(tmp_path / "in"))
    stream = state.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run_in_turns(stateful.changed_content(stream), "out", str(tmp_path))
    got = sorted(x.n for x in state.read.parquet(str(tmp_path / "out")).collect())
    last, want = {}, []
    for layer, path, h, n in rows:
        if last.get((layer, path)) != h:
            want.append(n)
        last[layer, path] = h
    assert got == want == sorted(x.n for x in stateful.changed_rows(every).collect()) and len(want) < 60


def pieces_of(messages, r):
    out = []
    for m, (reasoning, content, calls, whole) in messages.items():
        rows = [("reasoning", None, None, None, p) for p in reasoning] + [("content", None, None, None, p) for p in content]
        for slot, parts in enumerate(calls):
            rows += [("call", slot, f"id{slot}" if k == 0 else None, "grep" if k == 0 else None, p) for k, p in enumerate(parts)]
        rows += [("usage", None, None, None, "7"), ("end", None, None, None, None)]
        rows = [(m, i, *x) for i, x in enumerate(rows)]
        if not whole:
            rows.pop(r.randrange(len(rows)))
        out += rows + [r.choice(rows)]  # one comes twice
    r.shuffle(out)
    return out


def test_messages_come_back_whole(state, tmp_path):
    r = random.Random(3)
    cut = lambda n: ["".join(r.choice("ab {é") for _ in range(r.randrange(0, 5))) for _ in range(n)]
    messages = {m: (cut(r.randrange(3)), cut(r.randrange(6)), [cut(2) for _ in range(r.randrange(3))], m % 4 != 3) for m in range(24)}
    rows = pieces_of(messages, r)
    schema = "message_id long, seq long, kind string, slot int, call_id string, name string, piece string"
    deltas = state.createDataFrame(rows, schema)
    want = {m: ("".join(a), "".join(b), "7", [(i, f"id{i}", "grep", "".join(c)) for i, c in enumerate(calls)]) for m, (a, b, calls, whole) in messages.items() if whole}
    told = lambda d: {x.message_id: (x.reasoning, x.content, x.usage, [tuple(c) for c in x.tool_calls]) for x in d.collect()}
    assert told(stateful.assemble(deltas)) == want
    write_parts([state.createDataFrame(rows[i::5], schema) for i in range(5)], str(tmp_path / "in"))
    stream = state.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run_in_turns(stateful.assemble_stream(stream), "out", str(tmp_path))
    found = state.read.parquet(str(tmp_path / "out"))
    assert told(found) == want and found.count() == len(want)
    assert stateful.assemble(deltas.limit(0)).count() == 0


def test_store_equals_replaying_events_one_by_one(spark, tmp_path):
    r = random.Random(4)
    paths, folders = ["a/x", "a/b/y", "a/b/z", "c/x", "d"], ["a", "a/b", "c"]
    for case in range(3):
        root, alive, n = str(tmp_path / f"s{case}"), {}, 0
        for epoch in range(4):
            events = []
            for _ in range(r.randrange(1, 6)):
                n += 1
                kind = r.choice(["add", "change", "unlink", "unlinkDir", "add"])
                events.append((r.choice(folders if kind == "unlinkDir" else paths), kind, n))
            for path, kind, _ in events:
                if kind == "unlinkDir":
                    alive = {p: t for p, t in alive.items() if not p.startswith(path + "/")}
                elif kind == "unlink":
                    alive.pop(path, None)
                else:
                    alive[path] = f"{path}@{epoch}"
            r.shuffle(events)
            batch = spark.createDataFrame(events, "path string, last_kind string, n int").withColumn("last_ts", F.timestamp_seconds("n"))
            fresh = spark.createDataFrame([(p, f"{p}@{epoch}") for p in paths], "file_path string, text string")
            maintain.write_epoch(root, epoch, batch, fresh)
            if epoch == 0:
                none = fresh.limit(0)
                assert {tuple(x) for x in maintain.apply_events(none, batch, fresh).collect()} == set(alive.items())
            assert {tuple(x) for x in maintain.read_store(spark, root).collect()} == set(alive.items()), events
        maintain.compact(spark, root, root + "-small")
        assert {tuple(x) for x in maintain.read_store(spark, root + "-small").collect()} == set(alive.items())


def test_progress_of_a_running_stream(spark, tmp_path):
    told, now = [], [0.0]
    progress = stateful.Progress(told.append, clock=lambda: now[0])
    reports = stateful.json_reports(spark, str(tmp_path / "reports"))
    spark.streams.addListener(progress)
    try:
        rows = spark.range(40).selectExpr("concat('p', id % 8) AS path", "id")
        write_parts([rows.where(f"id % 4 = {i}") for i in range(4)], str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        query = stateful.counted(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        until = time.time() + 30
        while sum(t["rows"] for t in told) < 40 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(progress)
    # the clock stood still: one report at once, and one of all the rest at the end
    assert [t["rows"] for t in told] == [10, 30] and told[0]["paths"] == 2 and told[1]["batch"] == 3
    for t in told:
        reports(t)
    assert sorted(json.loads(x.value)["rows"] for x in spark.read.text(str(tmp_path / "reports")).collect()) == [10, 30]
