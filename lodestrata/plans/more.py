"""Registered queries of table functions, turn audits, conversation files, modes, display, streams' batch forms and plain text rules, with the SQL that gives the same rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import display
from ..functions import text as X
from ..operators import assess, blocks, code, corpus, layout, measure, modes, search, settings
from ..operators.structure import roman
from ..sources import conversations, files
from ..streaming import stateful
from .queries import _BM25, _MSG, _cycle, _docs, query


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
b AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1) // 500 AS block FROM l)
SELECT doc_id AS id, CAST(block AS BIGINT) AS block, min(n) AS line_start, max(n) AS line_end, string_agg(line, chr(10) ORDER BY n) AS text FROM b GROUP BY doc_id, block""")
def text_blocks(t):
    lines = corpus.lines(_docs(t))
    blocks.register(lines.sparkSession)
    return lines.sparkSession.sql("SELECT * FROM text_blocks(size => 500, rows => TABLE(SELECT id, line_number, line FROM {lines}) PARTITION BY id ORDER BY line_number)", lines=lines)


_TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[^\s\x{0B}]+'))"
_USAGE = f"""u AS (SELECT conv_id, turn, NULL AS agent, CASE conv_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'other' END AS model, CASE WHEN role = 'assistant' THEN 0 ELSE n END AS i, CASE WHEN role = 'assistant' THEN n ELSE 0 END AS o, CASE WHEN role = 'assistant' THEN 0 ELSE n END AS l FROM (SELECT *, {_TOKENS} AS n FROM conversations)
UNION ALL SELECT conv_id, turn, 'reader', 'small', CAST(ceil(length(text) / 4.0) AS BIGINT), n, 2 * n FROM (SELECT *, {_TOKENS} AS n FROM conversations) WHERE role = 'assistant' AND turn % 4 = 3),
p AS (SELECT *, CASE model WHEN 'small' THEN 0.1 WHEN 'large' THEN 2.0 ELSE 0.3 END AS ri, CASE model WHEN 'small' THEN 0.4 WHEN 'large' THEN 8.0 ELSE 1.1 END AS ro, CASE model WHEN 'small' THEN 0.0 WHEN 'large' THEN 0.5 ELSE 0.2 END AS rm FROM u),
c AS (SELECT *, (CASE WHEN agent IS NULL THEN i ELSE greatest(0, i - l) END * ri + o * ro + l * rm) / 1e6 AS cost FROM p)"""


@query(f"""WITH {_USAGE}, r AS (SELECT grouping(conv_id, turn) AS g, conv_id, turn, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, count(agent) AS sub_agents, sum(cost) AS cost FROM c GROUP BY ROLLUP (conv_id, turn))
SELECT CASE g WHEN 0 THEN 'turn' WHEN 1 THEN 'conversation' ELSE 'total' END AS level, coalesce(conv_id, -1) AS conv_id, coalesce(turn, -1) AS turn, tokens_in, tokens_out, sub_agents, round(cost, 9) AS cost,
CAST(sum(tokens_in) OVER (PARTITION BY g, conv_id ORDER BY turn) AS BIGINT) AS running_in, CAST(sum(tokens_out) OVER (PARTITION BY g, conv_id ORDER BY turn) AS BIGINT) AS running_out FROM r""")
def audit_turns(t):
    n = X.word_count(F.col("text")).cast("long")
    m = t("conversations").withColumn("n", n)
    said = F.col("role") == "assistant"
    none = F.lit(0).cast("long")
    read = F.when(said, none).otherwise(F.col("n"))
    own = m.select("conv_id", "turn", F.lit(None).cast("string").alias("agent"), _cycle("conv_id", "small", "large", "other").alias("model"), read.alias("tokens_in"), F.when(said, F.col("n")).otherwise(none).alias("tokens_out"), read.alias("last_in"))
    sub = m.where(said & (F.col("turn") % 4 == 3)).select("conv_id", "turn", F.lit("reader").alias("agent"), F.lit("small").alias("model"), F.ceil(F.length("text") / 4).alias("tokens_in"), F.col("n").alias("tokens_out"), (2 * F.col("n")).alias("last_in"))
    prices = m.sparkSession.createDataFrame([("small", 0.1, 0.4, 0.0), ("large", 2.0, 8.0, 0.5)], "model string, rate_in double, rate_out double, rate_missed double")
    got = measure.audit_turns(own.unionByName(sub), prices, (0.3, 1.1, 0.2))
    return got.withColumns({"conv_id": F.coalesce("conv_id", F.lit(-1)), "turn": F.coalesce("turn", F.lit(-1)), "cost": F.round("cost", 9)})


def _saved(t):
    """Conversations as files, every ninth cut short in its file, read back."""
    c = t("conversations")
    spark = c.sparkSession
    root = files.scratch_folder(spark, "conversations")
    message = F.struct("turn", "role", F.col("text").alias("content"), F.concat(F.lit("thinks of "), F.col("role")).alias("reasoning_content"))
    each = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("ms"))
    each = each.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("title"), F.timestamp_seconds(1704067200 + F.col("conv_id") % 5 * 86400).alias("saved_at"), F.lit("m").alias("model_name"), F.transform("ms", lambda m: m.dropFields("turn")).alias("messages"), "conv_id")
    conversations.save_conversations(each.where("conv_id % 9 <> 0").drop("conv_id"), root)
    cut = each.where("conv_id % 9 = 0").withColumn("day", F.date_format("saved_at", "yyyy-MM-dd"))
    whole = F.to_json(F.struct("title", "saved_at", "messages"))
    cut.select(F.substr(whole, F.lit(1), F.floor(F.length(whole) * 2 / 3).cast("int")).alias("value"), "day").write.mode("append").partitionBy("day").text(root)
    return conversations.read_conversations(spark, root)


@query("""WITH o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE conv_id % 9 <> 0)
SELECT '2024-01-0' || (1 + conv_id % 5) AS day, 'c' || conv_id AS title, CAST(place AS INTEGER) AS place, role, text AS content FROM o""")
def conversation_files(t):
    whole = _saved(t).where("NOT damaged")
    return whole.select("day", "title", F.posexplode("messages").alias("place", "m")).select(F.date_format(F.col("day").cast("date"), "yyyy-MM-dd").alias("day"), "title", "place", "m.role", "m.content")


@query("SELECT '2024-01-0' || (1 + conv_id % 5) AS day, count(DISTINCT conv_id) FILTER (WHERE conv_id % 9 <> 0) AS whole, count(DISTINCT conv_id) FILTER (WHERE conv_id % 9 = 0) AS damaged FROM conversations GROUP BY ALL")
def conversation_damage(t):
    return conversations.damage(_saved(t)).withColumn("day", F.date_format(F.col("day").cast("date"), "yyyy-MM-dd"))


@query("""WITH m AS (SELECT conv_id, turn, ['auto', 'manual', 'OFF', 'Auto', 'else'][conv_id % 5 + 1] AS mode, ['', '@rag ', ' @RAG:keyword ', '@rag:exact ', '@rag:other ', '@ragged '][turn % 6 + 1] AS head, text FROM conversations),
g AS (SELECT *, CASE turn % 6 WHEN 1 THEN 'manual' WHEN 2 THEN 'keyword' WHEN 3 THEN 'exact' ELSE '' END AS tag FROM m)
SELECT conv_id, turn, tag, CASE WHEN tag = '' THEN head || text ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS rest, mode <> 'OFF' AND (tag <> '' OR mode <> 'manual') AS enabled, mode <> 'OFF' AND tag <> '' AS force,
CASE WHEN mode = 'OFF' OR tag IN ('keyword', 'exact') THEN 'keyword' ELSE 'hybrid' END AS search_mode FROM g""")
def search_modes(t):
    head = _cycle("turn", "", "@rag ", " @RAG:keyword ", "@rag:exact ", "@rag:other ", "@ragged ")
    m = t("conversations").select("conv_id", "turn", _cycle("conv_id", "auto", "manual", "OFF", "Auto", "else").alias("mode"), F.concat(head, "text").alias("text"))
    return modes.resolve(m).select("conv_id", "turn", F.coalesce("tag", F.lit("")).alias("tag"), "rest", "enabled", "force", "search_mode")


_INSERTED = "中́‍\U0001f600️"


def _width_sql(x: str) -> str:
    count = lambda ranges: f"len(regexp_extract_all({x}, '{display.character_class(ranges)}'))"
    return f"(length({x}) - {count(display.NO_CELL)} + {count(display.TWO_CELLS)})"


@query(f"""WITH d AS (SELECT doc_id, regexp_replace(text, '([aeiou]) ', '\\1{_INSERTED} ', 'g') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, text, CASE WHEN len(ws) = 0 THEN '' ELSE list_reduce(list_transform(ws, lambda x: {{'s': x, 'n': {_width_sql('x')}}}), lambda a, b: CASE WHEN a.n + 1 + b.n <= 60 THEN {{'s': a.s || ' ' || b.s, 'n': a.n + 1 + b.n}} ELSE {{'s': a.s || chr(10) || b.s, 'n': b.n}} END).s END AS wrapped FROM w)
SELECT doc_id, CAST({_width_sql('text')} AS INTEGER) AS width, sha256(wrapped) AS wrapped FROM l""")
def display_widths(t):
    text = F.regexp_replace("text", "([aeiou]) ", f"$1{_INSERTED} ")
    return t("documents").select("doc_id", text.alias("text")).select("doc_id", display.width(F.col("text")).alias("width"), F.sha2(display.wrapped(F.col("text"), 60).cast("binary"), 256).alias("wrapped"))


# every message as pieces of 40 characters: reasoning before an assistant's content, a call's arguments of a user's; every eleventh conversation lost its second piece
@query("""WITH m AS (SELECT conv_id, turn, role, text, length(text) > 40 AND conv_id % 11 = 5 AS lost FROM conversations)
SELECT conv_id || '/' || turn AS message_id, CASE WHEN role = 'assistant' THEN left(text, 40) ELSE '' END AS reasoning, CASE WHEN role = 'assistant' THEN substring(text, 41) ELSE '' END AS content, CASE WHEN role = 'assistant' THEN '' ELSE 'grep:' || text END AS call FROM m WHERE NOT lost""")
def message_assembly(t):
    m = t("conversations").select(F.concat_ws("/", "conv_id", "turn").alias("message_id"), "conv_id", "role", "text")
    many = F.greatest(F.lit(1), F.ceil(F.length("text") / 40)).cast("int")
    cut = m.select("message_id", "conv_id", "role", F.explode(F.sequence(F.lit(0), many)).alias("seq"), "text", many.alias("many"))
    said = F.col("role") == "assistant"
    kind = F.when(F.col("seq") == F.col("many"), "end").when(~said, "call").when(F.col("seq") == 0, "reasoning").otherwise("content")
    first = ~said & (F.col("seq") == 0)
    pieces = cut.where(~((F.col("conv_id") % 11 == 5) & (F.col("seq") == 1) & (F.col("many") > 1))).select(
        "message_id", "seq", kind.alias("kind"), F.when(~said, F.lit(0)).alias("slot"), F.when(first, F.lit("call_1")).alias("call_id"), F.when(first, F.lit("grep")).alias("name"),
        F.when(F.col("seq") < F.col("many"), F.substr("text", F.col("seq") * 40 + 1, F.lit(40))).alias("piece"),
    )
    whole = stateful.assemble(pieces.unionByName(pieces.where("seq % 3 = 0")))
    call = F.get("tool_calls", F.lit(0))
    return whole.select("message_id", "reasoning", "content", F.coalesce(F.concat(call["name"], F.lit(":"), call["arguments"]), F.lit("")).alias("call"))


# a file's content seen by days: a document's hash changes with every third day
@query("""WITH e AS (SELECT doc_id, d, sha256(text || (d // 3)) AS h FROM documents CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS d)), p AS (SELECT *, lag(h) OVER (PARTITION BY doc_id ORDER BY d) AS before FROM e)
SELECT doc_id, CAST(d AS INTEGER) AS day FROM p WHERE h IS DISTINCT FROM before""")
def content_changes(t):
    days = t("documents").select("doc_id", F.col("lang").alias("layer"), F.concat_ws("/", "source", "doc_id").alias("path"), "text", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day"))
    seen = days.withColumns({"file_hash": F.sha2(F.concat("text", F.floor(F.col("day") / 3).cast("string")).cast("binary"), 256), "ts": F.timestamp_seconds("day")})
    return stateful.changed_rows(seen).select("doc_id", "day")


# languages are told by the letter frequencies of all documents of each
_LETTERS = r"unnest(regexp_extract_all(lower(text), '\p{L}'))"


@query(f"""WITH k AS (SELECT lang, letter, count(*) AS n FROM (SELECT lang, {_LETTERS} AS letter FROM documents) GROUP BY ALL), w AS (SELECT lang, letter, ln(n / sum(n) OVER (PARTITION BY lang)) AS weight FROM k),
t AS (SELECT doc_id, letter, count(*) AS n FROM (SELECT doc_id, {_LETTERS} AS letter FROM documents) GROUP BY ALL), s AS (SELECT doc_id, l.lang, round(sum(n * coalesce(weight, -14)), 6) AS s FROM t CROSS JOIN (SELECT DISTINCT lang FROM k) l LEFT JOIN w ON w.lang = l.lang AND w.letter = t.letter GROUP BY doc_id, l.lang),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS place FROM s)
SELECT d.doc_id AS id, coalesce(r.lang, '') AS lang FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND place = 1""")
def document_languages(t):
    docs = t("documents")
    profiles = assess.language_profiles(docs)
    return assess.identify_language(docs.select(F.col("doc_id").alias("id"), "text"), profiles).withColumn("lang", F.coalesce("lang", F.lit("")))


# scenarios of benchmark texts: their first and last words are the markers, every fifth is out of scope and was declined if it found nothing of its source
_RUBRIC = f"""sn AS (SELECT item_id AS qid, text AS query, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws, 'src' || item_id % 4 || '/' AS source, item_id % 5 = 0 AS oos, ['', 'en', 'de'][item_id % 3 + 1] AS language FROM benchmark),
fr AS (SELECT qid, rk.id, rank, 1 - 1 / (1 + score) AS sat, d.source || '/x.md' AS path, d.text, lang FROM rk JOIN documents d ON d.doc_id = rk.id WHERE rank <= 5),
cx AS (SELECT qid, string_agg(text, ' ' ORDER BY rank) AS context, list(path) AS paths, arg_min(sat, rank) AS top, arg_min(lang, rank) AS found FROM fr GROUP BY qid),
an AS (SELECT fr.qid, arg_min(CASE WHEN length(fr.text) > 500 THEN left(fr.text, 500) || '...' ELSE fr.text END, (NOT contains(path, source), rank)) AS answer, bool_or(contains(path, source)) AS own FROM fr JOIN sn ON sn.qid = fr.qid GROUP BY fr.qid),
j AS (SELECT sn.*, [ws[1], ws[-1], 'zzz'] AS markers, coalesce(context, '') AS context, coalesce(paths, []) AS paths, top, coalesce(found, '') AS found, CASE WHEN oos AND NOT coalesce(own, false) THEN NULL ELSE answer END AS answer FROM sn LEFT JOIN cx ON cx.qid = sn.qid LEFT JOIN an ON an.qid = sn.qid),
m AS (SELECT *, len(list_filter(markers, lambda k: contains(lower(context), lower(k)))) / 3.0 AS hit, len(list_filter(paths, lambda p: contains(p, source))) > 0 AS src, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) > 4)) AS truth,
list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) > 3) AS asked, coalesce(answer, '') AS said FROM j),
v AS (SELECT *, len(list_filter(truth, lambda w: contains(lower(context), w))) / greatest(len(truth), 1)::DOUBLE AS ground, len(list_filter(asked, lambda w: contains(lower(said), w))) / greatest(len(asked), 1)::DOUBLE AS met,
len(list_filter(markers, lambda k: contains(lower(said), lower(k)))) > 0 AS marked, len(list_filter(markers, lambda k: contains(context, k) OR contains(said, k))) > 0 AS kept FROM m),
ru AS (SELECT qid, oos, CASE WHEN oos THEN CASE WHEN top IS NULL THEN 5 WHEN top < 0.6 THEN 4 ELSE 2 END WHEN hit >= 0.75 AND src THEN 5 WHEN hit >= 0.5 AND src THEN 4 WHEN hit >= 0.25 OR src THEN 3 WHEN hit > 0 THEN 2 ELSE 1 END AS context_relevance,
CASE WHEN oos THEN 0 WHEN ground >= 0.8 THEN 5 WHEN ground >= 0.6 THEN 4 WHEN ground >= 0.4 THEN 3 WHEN ground >= 0.2 THEN 2 ELSE 1 END AS faithfulness,
CASE WHEN oos THEN CASE WHEN answer IS NULL THEN 5 ELSE 1 END WHEN met >= 0.6 AND marked THEN 5 WHEN met >= 0.4 AND marked THEN 4 WHEN met >= 0.3 OR marked THEN 3 WHEN met > 0 THEN 2 ELSE 1 END AS answer_relevance,
CASE WHEN oos THEN 4 WHEN language = '' THEN CASE WHEN found <> '' AND kept THEN 5 WHEN found <> '' THEN 3 ELSE 1 END WHEN found = language THEN CASE WHEN kept THEN 5 ELSE 4 END WHEN found <> '' AND kept AND language <> 'en' THEN 3 ELSE 2 END AS language_naturalness,
CASE WHEN NOT oos THEN 'NA' WHEN coalesce(top, 0) < 0.6 THEN 'PASS' ELSE 'WARN' END AS hallucination FROM v)"""


def _rubric(t):
    items = t("benchmark")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    none = F.lit(None).cast("string")
    scenarios = items.select(
        F.col("item_id").alias("qid"), F.col("text").alias("query"), F.array(F.get(words, F.lit(0)), F.element_at(words, -1), F.lit("zzz")).alias("expected_markers"),
        F.concat(F.lit("src"), (F.col("item_id") % 4).cast("string"), F.lit("/")).alias("expected_source"), F.col("text").alias("ground_truth"), (F.col("item_id") % 5 == 0).alias("out_of_scope"),
        F.when(F.col("item_id") % 3 == 1, "en").when(F.col("item_id") % 3 == 2, "de").otherwise(none).alias("language"),
    )
    about = t("documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/x.md")).alias("file_path"), "text", "lang")
    found = search.bm25(scenarios.select("qid", "query"), search.build_index(_docs(t), queries=scenarios.select("qid", "query")), 5).join(about, "id").withColumn("score", X.saturation(F.col("score"))).persist()  # five scores read it
    answers = measure.plain_answers(found, scenarios.select("qid", F.col("expected_source").alias("source")))
    own = found.join(scenarios.select("qid", "expected_source", "out_of_scope"), "qid").groupBy("qid").agg(F.bool_and("out_of_scope").alias("oos"), F.bool_or(F.contains("file_path", F.col("expected_source"))).alias("own"))
    answers = answers.join(own, "qid", "left").select("qid", F.when(~(F.col("oos") & ~F.col("own")), F.col("answer")).alias("answer"))
    languages = found.groupBy("qid").agg(F.min_by("lang", "rank").alias("lang"))
    return assess.rubric(scenarios, found, answers, languages)


@query(f"WITH {_BM25}, {_RUBRIC} SELECT qid, context_relevance, faithfulness, answer_relevance, language_naturalness, hallucination FROM ru")
def rubric_scores(t):
    return _rubric(t).select("qid", "context_relevance", F.coalesce("faithfulness", F.lit(0)).alias("faithfulness"), "answer_relevance", "language_naturalness", "hallucination")


@query(f"""WITH {_BM25}, {_RUBRIC}, g AS (SELECT count(*) AS n, avg(context_relevance) AS c, coalesce(avg(faithfulness) FILTER (WHERE NOT oos), 0) AS f, avg(answer_relevance) AS a, coalesce(avg(language_naturalness) FILTER (WHERE NOT oos), 0) AS l, count(*) FILTER (WHERE oos) AS outside, count(*) FILTER (WHERE oos AND hallucination IN ('PASS', 'WARN')) AS handled FROM ru)
SELECT n, round(c, 6) AS context_relevance, round(f, 6) AS faithfulness, round(a, 6) AS answer_relevance, round(l, 6) AS language_naturalness, outside, handled, round((c + f + a + l) / 4, 6) AS overall, c >= 3.5 AND f >= 3.5 AND a >= 3.0 AND handled >= 0.67 * outside AS passed FROM g""")
def rubric_gate(t):
    g = assess.rubric_gate(_rubric(t))
    return g.select(*(F.round(c, 6).alias(c) if dict(g.dtypes)[c] == "double" else F.col(c) for c in g.columns))


# paths of documents with endings and folders that rules tell apart
@query(r"""WITH p AS (SELECT doc_id, lang || '/' || ['docs', 'node_modules/x', 'src', 'drafts', 'keep'][doc_id % 5 + 1] || '/' || doc_id || ['.md', '.PY', '', '.exe', '.env', '.log', '.local.env'][doc_id % 7 + 1] AS path FROM documents)
SELECT doc_id, path, NOT contains(path, '/node_modules/') AND doc_id % 7 NOT IN (3, 4, 6) AND NOT (contains(path, '/drafts/') OR (doc_id % 7 = 5 AND NOT contains(path, '/keep/'))) AS indexed FROM p""")
def indexed_paths(t):
    ending = _cycle("doc_id", ".md", ".PY", "", ".exe", ".env", ".log", ".local.env")
    path = F.concat(F.concat_ws("/", "lang", _cycle("doc_id", "docs", "node_modules/x", "src", "drafts", "keep"), F.col("doc_id").cast("string")), ending)
    rules = ["# a comment", "", "drafts/", "*.log", "!keep"]
    return t("documents").select("doc_id", path.alias("path")).select("doc_id", "path", corpus.indexable(F.col("path"), rules).alias("indexed"))


# an assistant's turn calls one of three tools with its text, and the next user turn answers it
@query(f"""WITH m AS (SELECT conv_id, turn, role, text, ['grep', 'read', 'tree'][conv_id % 3 + 1] AS tool FROM conversations), c AS (SELECT tool, 1 AS k, 0.0 AS i, 1.6 + 1.6 + length(text) / 4.0 * 1.6 + 12 AS o FROM m WHERE role = 'assistant'),
a AS (SELECT tool, 0 AS k, {_MSG} AS i, 0.0 AS o FROM m WHERE role = 'user' AND turn > 0), s AS (SELECT tool, sum(k) AS calls, CAST(round(sum(i)) AS BIGINT) AS tokens_in, CAST(round(sum(o)) AS BIGINT) AS tokens_out FROM (SELECT * FROM c UNION ALL SELECT * FROM a) GROUP BY tool)
SELECT tool, CAST(calls AS BIGINT) AS calls, tokens_in, tokens_out, round((tokens_in * 0.27 + tokens_out * 1.1) / 1e6, 9) AS cost FROM s""")
def tool_usage(t):
    c = t("conversations")
    tool = _cycle("conv_id", "grep", "read", "tree")
    call = F.array(F.struct(F.concat(F.lit("call_"), F.col("turn").cast("string")).alias("id"), tool.alias("name"), F.col("text").alias("arguments")))
    m = c.select(F.when(F.col("role") == "assistant", "assistant").when(F.col("turn") > 0, "tool").otherwise("user").alias("role"), tool.alias("name"), "text", F.when(F.col("role") == "assistant", call).alias("tool_calls"))
    return measure.tool_usage(m, 0.27, 1.1).withColumn("cost", F.round("cost", 9))


# documents as books: pages of six lines under a running title, over a number in Arabic or Roman figures
_ROMAN = ", ".join(f"'{roman(i).lower()}'" for i in range(1, 100))


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents), g AS (SELECT doc_id, (n - 1) // 6 AS page, string_agg(line, chr(10) ORDER BY n) AS body FROM l GROUP BY ALL),
c AS (SELECT doc_id, count(*) AS pages FROM g GROUP BY doc_id), b AS (SELECT doc_id, CASE WHEN pages >= 3 THEN '' ELSE 'A running title' || chr(10) END AS head, pages, page, body, CASE WHEN pages >= 3 THEN '' ELSE chr(10) || CASE WHEN doc_id % 2 = 0 THEN CAST(page + 1 AS VARCHAR) ELSE [{_ROMAN}][page % 99 + 1] END END AS foot FROM g JOIN c USING (doc_id))
SELECT doc_id AS id, regexp_replace(string_agg(head || body || foot, chr(10) ORDER BY page), '(\\w)-\\n(\\w)', '\\1\\2', 'g') AS text FROM b GROUP BY doc_id""")
def cleaned_pages(t):
    lines = corpus.lines(_docs(t)).withColumn("page", F.floor((F.col("line_number") - 1) / 6).cast("int"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "line"))), lambda r: r["line"]), "\n")
    numerals = F.array(*(F.lit(roman(i).lower()) for i in range(1, 100)))
    number = F.when(F.col("id") % 2 == 0, (F.col("page") + 1).cast("string")).otherwise(F.get(numerals, F.col("page") % 99))
    pages = lines.groupBy("id", "page").agg(body.alias("body")).select("id", "page", F.concat(F.lit("A running title\n"), "body", F.lit("\n"), number).alias("text"))
    return corpus.page_cleanup(pages)


@query(r"""WITH d AS (SELECT doc_id, turn, CASE i WHEN 0 THEN '## Part #one [Two] ' || w ELSE '#tag [12] #9 ' || w || ' [' || w || ']' END AS line FROM (SELECT conv_id AS doc_id, turn, turn % 2 AS i, regexp_replace(lower(text), '[^a-z]', '', 'g') AS w FROM conversations))
SELECT doc_id AS conv_id, turn, CASE WHEN starts_with(line, '##') THEN 2 ELSE 0 END AS level, CASE WHEN starts_with(line, '##') THEN line[4:] ELSE '' END AS title, array_to_string(CASE WHEN starts_with(line, '##') THEN ['one', 'two'] ELSE list_sort(list_distinct(list_filter(['tag', regexp_extract(line, '\[([a-z]+)\]$', 1)], lambda x: x <> ''))) END, '|') AS tags FROM d""")
def line_marks(t):
    w = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    line = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("## Part #one [Two] "), w)).otherwise(F.concat(F.lit("#tag [12] #9 "), w, F.lit(" ["), w, F.lit("]")))
    return t("conversations").select("conv_id", "turn", line.alias("line")).select("conv_id", "turn", X.heading_level(F.col("line")).alias("level"), X.heading_title(F.col("line")).alias("title"), F.array_join(X.tags(F.col("line")), "|").alias("tags"))


@query("""WITH d AS (SELECT conv_id, turn, lpad(CAST(1 + conv_id % 28 AS VARCHAR), 2, '0') || '.0' || (1 + turn % 9) || '.2024' AS folder, '1' || (turn % 10) || '.30.' || (10 + conv_id % 50) || CASE turn % 3 WHEN 0 THEN ' - ' || replace(text, chr(10), ' ') ELSE '' END || '.json' AS file, turn % 3 AS k, replace(text, chr(10), ' ') AS text FROM conversations)
SELECT conv_id, turn, strftime(strptime(folder || ' ' || left(file, 8), '%d.%m.%Y %H.%M.%S'), '%Y-%m-%d %H:%M:%S') AS saved, CASE k WHEN 0 THEN text ELSE '' END AS title FROM d""")
def saved_names(t):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    folder = F.concat(two(1 + F.col("conv_id") % 28), F.lit(".0"), (1 + F.col("turn") % 9).cast("string"), F.lit(".2024"))
    named = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" - "), F.replace("text", F.lit("\n"), F.lit(" ")))).otherwise("")
    file = F.concat(F.lit("1"), (F.col("turn") % 10).cast("string"), F.lit(".30."), (10 + F.col("conv_id") % 50).cast("string"), named, F.lit(".json"))
    d = t("conversations").select("conv_id", "turn", folder.alias("folder"), file.alias("file"))
    return d.select("conv_id", "turn", F.date_format(X.saved_at(F.col("folder"), F.col("file")), "yyyy-MM-dd HH:mm:ss").alias("saved"), F.coalesce(X.saved_title(F.col("file")), F.lit("")).alias("title"))


@query("""WITH l AS (SELECT doc_id, CAST(n AS INTEGER) AS line_number, string_split(line, ' ') AS ws FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT doc_id, line_number, array_to_string(list_transform(ws, lambda w: trim(w)), '~') AS cells FROM l WHERE array_to_string(ws, '') NOT LIKE '%|%'""")
def table_rows(t):
    lines = corpus.lines(t("documents").select(F.col("doc_id").alias("id"), "text")).where(~F.contains("line", F.lit("|")))
    row = F.concat(F.lit(" | "), F.replace("line", F.lit(" "), F.lit(" | ")), F.lit(" |"))
    return lines.select(F.col("id").alias("doc_id"), "line_number", F.array_join(X.table_cells(row), "~").alias("cells"))


@query(r"""WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS text, count(*) FILTER (WHERE role IN ('user', 'assistant') AND regexp_matches(text, '(?i)\bthe\b')) AS hits FROM conversations GROUP BY conv_id),
g AS (SELECT lower(trim(string_split(text, ' ')[1])) AS title, conv_id, hits FROM f WHERE text IS NOT NULL)
SELECT title, count(*) AS versions, count(*) FILTER (WHERE hits > 0) AS matching, max(conv_id) AS latest FROM g GROUP BY title HAVING count(*) FILTER (WHERE hits > 0) > 0""")
def history_versions(t):
    m = t("conversations")
    titles = m.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).select("conv_id", F.get(F.split("text", " "), F.lit(0)).alias("title"))
    return measure.history_versions(m, "the", titles)


@query(r"""WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'C:\data\' || lang || '\' || source || '\' || doc_id || '.TXT' WHEN 1 THEN 'C:/data/' || doc_id || '.tar.gz' WHEN 2 THEN 'D:/else/' || source || '/.env' ELSE 'C:/data/' || lang || '/none' END AS path FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '/' || source WHEN 1 THEN '' WHEN 2 THEN 'D:/else/' || source ELSE lang END AS namespace, CASE doc_id % 4 WHEN 0 THEN doc_id || '.TXT' WHEN 1 THEN doc_id || '.tar.gz' WHEN 2 THEN '.env' ELSE 'none' END AS name, ['txt', 'gz', '', ''][doc_id % 4 + 1] AS extension FROM p JOIN documents USING (doc_id)""")
def path_parts(t):
    key = F.col("doc_id").cast("string")
    n = F.col("doc_id") % 4
    path = F.when(n == 0, F.concat(F.lit("C:\\data\\"), "lang", F.lit("\\"), "source", F.lit("\\"), key, F.lit(".TXT"))).when(n == 1, F.concat(F.lit("C:/data/"), key, F.lit(".tar.gz")))
    path = path.when(n == 2, F.concat(F.lit("D:/else/"), "source", F.lit("/.env"))).otherwise(F.concat(F.lit("C:/data/"), "lang", F.lit("/none")))
    d = t("documents").select("doc_id", path.alias("path"))
    return d.select("doc_id", X.namespace(F.col("path"), "C:\\data").alias("namespace"), X.base_name(F.col("path")).alias("name"), X.extension(F.col("path")).alias("extension"))


@query("""SELECT doc_id, CAST(length(text) - length(replace(text, 'a ', 'a')) AS INTEGER) AS removed FROM documents""")
def invisible_counts(t):
    marked = F.replace("text", F.lit("a "), F.lit("a\u200b "))
    return t("documents").select("doc_id", X.invisible_count(marked).alias("removed"))


# vectors as paragraphs, ten a text
@query(f"""WITH p AS (SELECT vec_id // 10 AS id, vec_id % 10 AS pos, vec_id, embedding AS v, lag(embedding) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id % 10) AS w FROM embeddings),
s AS (SELECT id, pos, vec_id, CASE WHEN w IS NOT NULL AND greatest(0, list_cosine_similarity(list_transform(v, lambda x: CAST(x AS DOUBLE)), list_transform(w, lambda x: CAST(x AS DOUBLE)))) < 0.35 THEN 1 ELSE 0 END AS cut FROM p),
g AS (SELECT *, sum(cut) OVER (PARTITION BY id ORDER BY pos) AS part FROM s)
SELECT CAST(id AS BIGINT) AS id, CAST(part AS BIGINT) AS part, string_agg('paragraph ' || vec_id, chr(10) || chr(10) ORDER BY pos) AS text FROM g GROUP BY ALL""")
def paragraph_groups(t):
    p = t("embeddings").select(F.floor(F.col("vec_id") / 10).alias("id"), (F.col("vec_id") % 10).alias("pos"), F.concat(F.lit("paragraph "), F.col("vec_id").cast("string")).alias("text"), F.col("embedding").alias("vector"))
    return assess.semantic_groups(p)


@query(r"""WITH s AS (SELECT doc_id, ['python', 'go', 'javascript', 'rust'][doc_id % 4 + 1] AS lang, ['import os', 'package main', 'export x', 'use y'][doc_id % 4 + 1] || chr(10) || text || chr(10) || ['from a import b', 'import "c"', 'const d = require("e")', 'z'][doc_id % 4 + 1] AS src FROM documents)
SELECT doc_id, array_to_string(list_filter(string_split(src, chr(10))[1:30], lambda l: CASE lang WHEN 'python' THEN regexp_matches(l, '^\s*(import|from) ') WHEN 'go' THEN regexp_matches(l, '^\s*(package |import)') WHEN 'javascript' THEN regexp_matches(l, '^\s*((import|export) |.*require\()') ELSE false END), chr(10)) AS header FROM s""")
def module_headers(t):
    head, tail = _cycle("doc_id", "import os", "package main", "export x", "use y"), _cycle("doc_id", "from a import b", 'import "c"', 'const d = require("e")', "z")
    d = t("documents").select("doc_id", _cycle("doc_id", "python", "go", "javascript", "rust").alias("lang"), F.concat_ws("\n", head, "text", tail).alias("src"))
    return d.select("doc_id", code.module_header(F.col("src"), F.col("lang")).alias("header"))


# documents as pages of sixty lines, their words placed by the characters before them
@query()
def page_layout(t):
    # texts that share an id share its pages
    texts = _docs(t).groupBy("id").agg(F.collect_list("text").alias("texts"))
    lines = texts.select("id", F.transform("texts", corpus.split_lines).alias("ts"))
    numbers = F.sequence(F.lit(0), F.floor((F.array_max(F.transform("ts", F.size)) - 1) / 60).cast("int"))
    rows = lambda ls, page: F.transform(F.slice(ls, page * 60 + 1, F.lit(60)), lambda line, row: F.struct(line.alias("line"), row.alias("row")))
    pages = lines.where(F.size("ts") > 0).select("id", F.posexplode(F.transform(numbers, lambda page: F.flatten(F.transform("ts", lambda ls: rows(ls, page))))).alias("page", "rows"))
    before = lambda line, pos: 5.0 * F.length(F.call_function("substring_index", line, F.lit(" "), pos)) + F.when(pos > 0, 5.0).otherwise(0.0)
    placed = lambda r: lambda word, pos: F.struct(word.alias("str"), before(r["line"], pos).alias("x"), (-12.0 * r["row"]).alias("y"), (5.0 * F.length(word)).alias("width"), F.lit(10.0).alias("height"))
    words = F.flatten(F.transform("rows", lambda r: F.filter(F.transform(F.split(r["line"], " "), placed(r)), lambda i: i["str"] != "")))
    found = layout.read_pages(pages.where(F.exists("rows", lambda r: F.trim(r["line"]) != "")).select("id", "page", words.alias("items")), whole=True)
    return found.select("id", "page", "text", F.coalesce("table", F.lit("")).alias("table"))


# two patches a document over the defaults
_PATCHES = """[['{"thresholds": {"min_score": 0.' || (1 + n % 8) || '}, "extra": {"a": {"b": [1, ' || n || ']}, "c": {}}}', '{"hybrid": {"rrf_k": ' || n || ', "mode": "x"}}', '{"watcher": "off"}', '{}'][n % 4 + 1], ['{"extra": "' || source || '"}', '{"hybrid": 7}', '{"watcher": {"active_layers": {"deep": {"er": true}}}}', '{"thresholds": {}, "reranker": {"enabled": false}}', '{"extra": {"c": {"d": 1}}}'][n % 5 + 1]]"""


@query(f"""WITH d AS (SELECT doc_id, source, length(text) AS n FROM documents), j AS (SELECT doc_id, json_merge_patch(CAST('{json.dumps(settings.DEFAULTS)}' AS JSON), CAST(p[1] AS JSON), CAST(p[2] AS JSON)) AS j FROM (SELECT doc_id, {_PATCHES} AS p FROM d)),
r AS (SELECT doc_id, t.* FROM j, json_tree(j.j) t)
SELECT doc_id AS id, fullkey[3:] AS path, CAST(value AS VARCHAR) AS value FROM r WHERE type <> 'OBJECT' AND NOT contains(fullkey, '[') UNION ALL SELECT doc_id, fullkey[3:], '{{}}' FROM r WHERE type = 'OBJECT' AND CAST(value AS VARCHAR) = '{{}}'""")
def merged_settings(t):
    n = F.length("text")
    text = n.cast("string")
    pick = lambda many, *values: F.get(F.array(*(v if hasattr(v, "cast") else F.lit(v) for v in values)), (n % many).cast("int"))
    one = pick(4, F.concat(F.lit('{"thresholds": {"min_score": 0.'), (1 + n % 8).cast("string"), F.lit('}, "extra": {"a": {"b": [1, '), text, F.lit(']}, "c": {}}}')), F.concat(F.lit('{"hybrid": {"rrf_k": '), text, F.lit(', "mode": "x"}}')), '{"watcher": "off"}', "{}")
    two = pick(5, F.concat(F.lit('{"extra": "'), "source", F.lit('"}')), '{"hybrid": 7}', '{"watcher": {"active_layers": {"deep": {"er": true}}}}', '{"thresholds": {}, "reranker": {"enabled": false}}', '{"extra": {"c": {"d": 1}}}')
    patches = t("documents").select(F.col("doc_id").alias("id"), F.posexplode(F.array(one, two)).alias("place", "json")).withColumn("place", F.col("place") + 1)
    return settings.settings(patches)
