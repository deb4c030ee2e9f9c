import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodestrata.functions import display
from lodestrata.operators import blocks, measure, modes, settings
from lodestrata.sources import conversations


def test_text_blocks(spark):
    blocks.register(spark)
    rows = [("a", i, line) for i, line in enumerate(["x" * 6, None, "y" * 3, "z" * 20, "w"], 1)] + [("b", 1, "alone")]
    spark.createDataFrame(rows, "id string, line_number long, line string").createOrReplaceTempView("ls")
    call = "SELECT * FROM text_blocks(size => {}, rows => TABLE(SELECT {} FROM ls) PARTITION BY id ORDER BY line_number)"
    got = {(r.id, r.block): (r.line_start, r.line_end, r.text) for r in spark.sql(call.format(10, "*, 1 AS extra")).collect()}
    assert got == {("a", 0): (1, 3, "x" * 6 + "\n\nyyy"), ("a", 1): (4, 4, "z" * 20), ("a", 3): (5, 5, "w"), ("b", 0): (1, 1, "alone")}
    for wrong in (call.format(0, "*"), call.format(5, "id, line_number"), "SELECT * FROM text_blocks(size => 5, rows => 7)"):
        with pytest.raises(AnalysisException):
            spark.sql(wrong).collect()


def test_audit_turns(spark):
    usage = [(1, 0, None, "m", 100, 10, 40), (1, 1, None, "q", 50, 0, 50), (1, 1, "reader", "m", 30, 5, 70), (2, 0, "reader", "m", 100, 5, 70)]
    u = spark.createDataFrame(usage, "conv_id int, turn int, agent string, model string, tokens_in int, tokens_out int, last_in int")
    prices = spark.createDataFrame([("m", 1.0, 2.0, 3.0)], "model string, rate_in double, rate_out double, rate_missed double")
    got = {(r.level, r.conv_id, r.turn): r for r in measure.audit_turns(u, prices, (10.0, 0.0, 0.0)).collect()}
    cost = {k: round(r.cost * 1e6, 6) for k, r in got.items()}
    assert cost == {("turn", 1, 0): 240.0, ("turn", 1, 1): 500 + 10 + 210, ("turn", 2, 0): 30 + 10 + 210, ("conversation", 1, None): 960.0, ("conversation", 2, None): 250.0, ("total", None, None): 1210.0}
    assert got["turn", 1, 1].running_in == 180 and got["conversation", 1, None].sub_agents == 1 and got["total", None, None].tokens_out == 20
    assert [r.level for r in measure.audit_turns(u.limit(0), prices, (1.0, 1.0, 1.0)).collect()] in ([], ["total"])


def test_conversations_come_back(spark, tmp_path):
    message = "array<struct<role: string, content: string, reasoning_content: string, tool_calls: array<struct<id: string, type: string, function: struct<name: string, arguments: string>>>>>"
    rows = [("a", [("user", "hi é\n\"x\"", None, None), ("assistant", "yo", "secret thought", [("1", "function", ("grep", "{}"))])]), ("b", None), ("c", [])]
    d = spark.createDataFrame(rows, f"title string, messages {message}").withColumn("saved_at", F.lit("2024-05-06 23:59:58").cast("timestamp")).withColumn("model_name", F.lit("m"))
    root = str(tmp_path / "h")
    conversations.save_conversations(d, root)
    assert "secret" not in "".join(p.read_text() for p in (tmp_path / "h").rglob("*.json"))
    (tmp_path / "h" / "day=2024-05-06" / "x.json").write_text('{"title": "cut", "messages": [{"role": "us')
    (tmp_path / "h" / "day=2024-05-06" / "y (AUDIT).json").write_text('{"title": "audit", "messages": []}')
    got = {r.title: r for r in conversations.read_conversations(spark, root).collect()}
    assert [(m.role, m.content) for m in got["a"].messages] == [("user", "hi é\n\"x\""), ("assistant", "yo")] and got["a"].messages[1].tool_calls[0].function.name == "grep"
    assert got["a"].message_count == 2 and got["c"].message_count == 0 and sum(r.damaged for r in got.values()) == 2 and "audit" not in got
    assert sorted(tuple(r)[1:] for r in conversations.damage(conversations.read_conversations(spark, root)).collect()) == [(2, 2)]
    one = tmp_path / "one" / "31.12.2024"
    one.mkdir(parents=True)
    (one / "23.59.58 - t.json").write_text(json.dumps({"saved_at": "2024-12-31T23:59:58.000Z", "model_name": "m", "message_count": 1, "messages": [{"role": "user", "content": "x", "reasoning_content": "y"}]}, indent=2))
    (one / "bad.json").write_text("{")
    read = conversations.read_conversations(spark, str(tmp_path / "one"), multi_line=True).collect()
    assert sorted((r.damaged, r.message_count) for r in read) == [(False, 1), (True, 0)] and "reasoning_content" not in next(r for r in read if not r.damaged).messages[0]


def test_mode_table(spark):
    """Every pair of mode and tag, with the ones that the table doesn't name."""
    rows = [(f"{tag} find it ", mode) for tag in ("", "@rag", " @RAG:Keyword", "@rag:exact", "@rag:else", "@ragged") for mode in ("auto", "manual", "off", "OFF", None, "else")] + [(None, "off"), (None, None)]
    got = modes.resolve(spark.createDataFrame(rows, "text string, mode string").selectExpr("*", "1 AS place")).collect()
    assert len(got) == len(rows)
    for r in got:
        tag = {"@rag": "manual", "@RAG:Keyword": "keyword", "@rag:exact": "exact"}.get((r.text or "").split()[0] if (r.text or "").strip() else "")
        mode = (r.mode or "auto").lower()
        if mode == "off":
            want = (False, False, "keyword")
        elif tag:
            want = (True, True, "hybrid" if tag == "manual" else "keyword")
        else:
            want = (mode != "manual", False, "hybrid")
        assert (r.tag, r.enabled, r.force, r.search_mode) == (tag, *want) and r.rest == ("find it" if tag else r.text or "")


def test_display_width_and_wrapping(spark):
    texts = ["", None, "abc", "中文", "éa‍b", "\U0001f600️ x", "ab cd ef", "a  b", "toolongword in it", "中 中 中"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.w, r.s) for r in d.select("i", display.width(F.col("t")).alias("w"), display.wrapped(F.col("t"), 5).alias("s")).collect()}
    inside = lambda c, ranges: any(a <= ord(c) <= b for a, b in ranges)
    wide = lambda s: sum(0 if inside(c, display.NO_CELL) else 2 if inside(c, display.TWO_CELLS) else 1 for c in s)
    for i, t in enumerate(texts):
        lines = []
        for w in (t or "").split(" "):
            if w and lines and wide(lines[-1]) + 1 + wide(w) <= 5:
                lines[-1] += " " + w
            elif w:
                lines.append(w)
        assert got[i] == (wide(t or ""), "\n".join(lines)), t
    assert got[3][0] == 4 and got[4][0] == 3 and got[5][0] == 4 and got[6][1] == "ab cd\nef"


def test_settings_equal_merging_one_by_one(spark):
    def merge(target, source):
        for k, v in source.items():
            if isinstance(v, dict):
                if not isinstance(target.get(k), dict):
                    target[k] = {}
                merge(target[k], v)
            else:
                target[k] = v

    def leaves(d, path=()):
        for k, v in d.items():
            if isinstance(v, dict) and v:
                yield from leaves(v, (*path, k))
            else:
                yield ".".join((*path, k)), v

    r = random.Random(8)
    value = lambda depth: {k: value(depth - 1) for k in r.sample("abc", r.randrange(3))} if depth and r.random() < 0.6 else r.choice([1, 2.5, "x", True, None, [1, {"a": 2}]])
    patches = {i: [{k: value(2) for k in r.sample("abc", 2)} for _ in range(3)] for i in range(25)}
    base = {"a": {"b": 1, "c": {"a": 2}}, "b": 3}
    rows = [(i, n + 1, json.dumps(p)) for i, ps in patches.items() for n, p in enumerate(ps)] + [(98, 1, "[1]"), (98, 2, "{broken"), (99, 1, None)]
    got = settings.settings(spark.createDataFrame(rows, "id int, place int, json string"), base).collect()
    found = {}
    for x in got:
        assert (x.id, x.path) not in found
        found[x.id, x.path] = json.loads(x.value)
    want = {}
    for i in [*patches, 98, 99]:
        whole = json.loads(json.dumps(base))
        for p in patches.get(i, []):
            merge(whole, p)
        want |= {(i, path): v for path, v in leaves(whole)}
    assert found == want


def test_long_texts_are_wrapped_in_proportion(spark):
    import time

    words = [("ab", "中", "", "ábc", "word", "éé")[i % 6] * (1 + i % 3) for i in range(400_000)]
    cells = lambda w: sum(0 if c == "́" else 2 if c == "中" else 1 for c in w)
    want, n = "", -1
    lines = []
    for w in filter(None, words):
        if n >= 0 and n + 1 + cells(w) <= 30:
            lines[-1].append(w)
            n += 1 + cells(w)
        else:
            lines.append([w])
            n = cells(w)
    want = "\n".join(" ".join(x) for x in lines)
    text = spark.createDataFrame([(" ".join(words),), (" ".join(["w"] * 64),), ("",), (None,)], "text string")
    began = time.perf_counter()
    got = [r.w for r in text.select(display.wrapped(F.col("text"), 30).alias("w")).collect()]
    assert got[0] == want and got[1] == "\n".join([" ".join(["w"] * 15)] * 4 + ["w w w w"]) and got[2:] == ["", ""]
    assert time.perf_counter() - began < 15
