"""Registered queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assess, chunk, code, corpus, measure, search, structure
from ..sources import extract, markdown
from ..streaming import maintain

QUERIES: dict = {}
ORACLES: dict = {}


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cycle(key, *values: str):
    """One of the values by a row's id, as inputs that the tables themselves don't hold."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(F.col(key), F.lit(len(values))).cast("int"))


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: _read(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def _tokens_sql(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"


_BM25 = f"""
t AS (SELECT doc_id AS id, {_tokens_sql('text')} AS ts FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)::DOUBLE) AS avgdl FROM t),
p AS (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM t), tf AS (SELECT id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_tokens_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT qid, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) AS score FROM q JOIN df USING (term) JOIN tf USING (term) CROSS JOIN st GROUP BY qid, id),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc)
"""


def _docs(t):
    return t("documents").select(F.col("doc_id").alias("id"), "text")


def _items(t):
    return t("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _sparse(t, limit):
    return search.bm25(_items(t), search.build_index(_docs(t), queries=_items(t)), limit)


@query(f"WITH {_BM25} SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM rk WHERE rank <= 10")
def bm25_search(t):
    return _sparse(t, 10).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id AS id, len(ts) AS n_tokens, len(list_distinct(ts)) AS n_distinct FROM (SELECT doc_id, {_tokens_sql('text')} AS ts FROM documents)")
def tokenize_documents(t):
    return _docs(t).select("id", X.tokens(F.col("text")).alias("ts")).select("id", F.size("ts").cast("long").alias("n_tokens"), F.size(F.array_distinct("ts")).cast("long").alias("n_distinct"))


@query(f"WITH {_BM25} SELECT term, df.df AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf JOIN df USING (term) GROUP BY ALL")
def term_statistics(t):
    i = search.build_index(_docs(t))
    return i.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


_COS = "greatest(0, least(1, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(q.v, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(c.v, lambda x: x::DOUBLE * x::DOUBLE))))))"
_DENSE = f"""
e AS (SELECT vec_id AS id, embedding AS v, label FROM embeddings),
ds AS (SELECT q.id AS qid, c.id AS id, {_COS} AS score FROM e q JOIN e c ON q.id % 20 = 0),
dk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM ds)
"""


def _vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("namespace"))


def _asked(v):
    return v.where(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), F.col("v").alias("qv"), "namespace")


@query(f"WITH {_DENSE} SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM dk WHERE rank <= 5")
def dense_search(t):
    v = _vectors(t)
    return search.dense(_asked(v).drop("namespace"), v.drop("namespace"), 5).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH e AS (SELECT vec_id AS id, embedding AS v, label FROM embeddings), ds AS (SELECT q.id AS qid, c.id AS id, {_COS} AS score FROM e q JOIN e c ON q.id % 20 = 0 AND q.label = c.label),
dk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM ds) SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM dk WHERE rank <= 5""")
def dense_search_namespace(t):
    v = _vectors(t)
    return search.dense(_asked(v), v, 5, ["namespace"]).select("qid", "id", "rank", F.round("score", 6).alias("score"))


_DENSE_ITEMS = f"""
e AS (SELECT vec_id AS id, embedding AS v FROM embeddings), ds AS (SELECT q.id AS qid, c.id AS id, {_COS} AS score FROM e q JOIN e c ON q.id IN (SELECT item_id FROM benchmark)),
dk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM ds)
"""
_HYBRID = f"""{_BM25}, {_DENSE_ITEMS},
s50 AS (SELECT qid, id, score AS bs, rank AS br FROM rk WHERE rank <= 50), d50 AS (SELECT qid, id, score AS dsc, rank AS dr FROM dk WHERE rank <= 50),
f AS (SELECT coalesce(s50.qid, d50.qid) AS qid, coalesce(s50.id, d50.id) AS id, bs, dsc, br, dr, coalesce(1 / (60.0 + dr), 0) + coalesce(1 / (60.0 + br), 0) AS rrf,
      coalesce(dsc, 1 - 1 / (1 + bs), 0) AS score FROM s50 FULL JOIN d50 ON s50.qid = d50.qid AND s50.id = d50.id),
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, dr NULLS LAST, br NULLS LAST, id) AS rank FROM f)
"""


def _hybrid(t):
    v = _vectors(t).drop("namespace")
    asked = v.join(_items(t).select("qid"), F.col("id") == F.col("qid")).select("qid", F.col("v").alias("qv"))
    return search.hybrid(_sparse(t, search.CANDIDATES), search.dense(asked, v))


@query(f"WITH {_HYBRID} SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, round(rrf, 9) AS rrf FROM h WHERE rank <= 5")
def hybrid_search(t):
    return _hybrid(t).where("rank <= 5").select("qid", "id", "rank", F.round("score", 6).alias("score"), F.round("rrf", 9).alias("rrf"))


@query(f"""WITH RECURSIVE {_HYBRID}, m AS (SELECT qid, id, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r, CAST(ceil(length(d.text) / 4.0) AS BIGINT) AS tokens FROM h JOIN documents d ON d.doc_id = h.id WHERE rank <= 20),
w AS (SELECT qid, id, rank, r, tokens, true AS kept, tokens AS used FROM m WHERE r = 1
      UNION ALL SELECT m.qid, m.id, m.rank, m.r, m.tokens, w.used + m.tokens <= 2700, CASE WHEN w.used + m.tokens <= 2700 THEN w.used + m.tokens ELSE w.used END FROM w JOIN m ON m.qid = w.qid AND m.r = w.r + 1)
SELECT qid, id, CAST(rank AS INTEGER) AS rank, tokens FROM w WHERE kept""")
def token_budget(t):
    sized = _hybrid(t).where("rank <= 20").join(_docs(t).select("id", X.budget_tokens(F.col("text")).alias("tokens")), "id")
    return search.within_budget(sized.select("qid", "id", "rank", "tokens"), 3000).select("qid", "id", "rank", "tokens")


@query(f"""WITH {_BM25}, l AS (SELECT qid, rk.id, score, rank, source FROM rk JOIN documents d ON d.doc_id = rk.id WHERE rank <= 50 AND lang = 'en' AND 1 - 1 / (1 + score) >= 0.9)
SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS rank, round(1 - 1 / (1 + score), 6) AS score FROM l""")
def keyword_search_layer(t):
    meta = t("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("layer"))
    got = _sparse(t, search.CANDIDATES).join(meta, "id").where(F.col("layer") == "en").withColumn("s", X.saturation(F.col("score"))).where(F.col("s") >= 0.9)
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).select("qid", "id", "rank", F.round("s", 6).alias("score"))


@query(f"""WITH {_BM25}, r AS (SELECT qid, rank, score, contains(d.text, b.text) AS good FROM rk JOIN documents d ON d.doc_id = rk.id JOIN benchmark b ON b.item_id = qid WHERE rank <= 10),
b AS (SELECT qid, min(rank) FILTER (WHERE good) AS first, sum((good AND rank <= 3)::INT) AS good3, arg_min(score, rank) AS top FROM r GROUP BY qid),
a AS (SELECT * FROM (SELECT item_id AS qid FROM benchmark) LEFT JOIN b USING (qid))
SELECT count(*) AS n, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit3, round(avg(coalesce(good3, 0) / 3.0), 6) AS p3,
       round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr, round(avg(coalesce(top, 0.0)), 6) AS avg_top_score FROM a""")
def retrieval_quality(t):
    got = _sparse(t, 10).join(_docs(t), "id").join(_items(t), "qid").withColumn("relevant", F.contains(F.col("text"), F.col("query")))
    m = measure.retrieval_metrics(got, _items(t))
    return m.select("n", *(F.round(c, 6).alias(c) for c in m.columns if c != "n"))


@query(r"""WITH d AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents),
h AS (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS n FROM d)
SELECT doc_id AS id, CAST(n AS INTEGER) AS line_number, ls[n] AS line, array_to_string(list_slice(ls, greatest(1, n - 2), least(len(ls), n + 2)), chr(10)) AS context FROM h WHERE contains(ls[n], '@mail')""")
def grep_literal(t):
    return corpus.grep(_docs(t), "@mail", limit=0)


@query(r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), h AS (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS n FROM d)
SELECT doc_id AS id, CAST(n AS INTEGER) AS line_number, ls[n] AS line, array_to_string(list_slice(ls, greatest(1, n - 1), least(len(ls), n + 1)), chr(10)) AS context
FROM h WHERE regexp_matches(ls[n], '[0-9]{3}-[0-9]{4}') ORDER BY id, line_number LIMIT 50""")
def grep_regex(t):
    return corpus.grep(_docs(t), "[0-9]{3}-[0-9]{4}", regex=True, context=1, limit=50)


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), h AS (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS n FROM d)
SELECT doc_id AS id, CAST(n AS INTEGER) AS line_number, lpad(CAST(n AS VARCHAR), 6, ' ') || '|' || ls[n] AS shown FROM h WHERE n BETWEEN 2 AND 4""")
def line_range(t):
    return corpus.line_range(_docs(t), 2, 4)


@query("""SELECT doc_id AS id, CAST(length(text) AS INTEGER) AS total_chars, CAST(ceil(length(text) / 3000.0) AS BIGINT) AS pages, sha256(substring(text, 1, 1024)) AS fingerprint,
CAST(least(length(text), 5000) AS INTEGER) AS shown_chars, length(text) > 5000 AS truncated FROM documents""")
def extract_preview(t):
    return corpus.preview(_docs(t), 5000)


@query(r"""SELECT page_id, list_extract(string_split(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.'), -2) AS source FROM pages""")
def url_source(t):
    return t("pages").select("page_id", X.host_label(F.col("url")).alias("source"))


@query()
def html_text(t):
    return extract.html_column(t("pages")).select("page_id", "text", F.length("text").alias("n_chars"))


@query()
def chunk_documents(t):
    return chunk.chunk_documents(t("documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), F.col("lang").alias("layer"), F.col("source").alias("namespace"), "text")).select("id", "layer", "namespace", "file_path", "line_start", "line_end", "text")


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\s\x{0B}]+'))"
_MSG = f"CASE WHEN length(text) > 10000 THEN length(text) / 4.0 * 1.6 ELSE {_WORDS} * 1.6 END"


@query(f"SELECT role, count(*) AS n_messages, round(sum({_MSG}), 4) AS tokens FROM conversations GROUP BY role")
def conversation_tokens(t):
    return measure.role_tokens(t("conversations")).withColumn("tokens", F.round("tokens", 4))


@query(f"""WITH m AS (SELECT conv_id, role, {_MSG} AS t FROM conversations), s AS (SELECT conv_id, sum(t) AS i, sum(CASE WHEN role = 'assistant' THEN t ELSE 0 END) AS o FROM m GROUP BY conv_id)
SELECT conv_id, round(i, 4) AS tokens_in, round(o, 4) AS tokens_out, round((i * 0.27 + o * 1.1) / 1e6, 9) AS cost FROM s""")
def conversation_cost(t):
    return measure.conversation_cost(t("conversations"), 0.27, 1.1).select("conv_id", F.round("tokens_in", 4).alias("tokens_in"), F.round("tokens_out", 4).alias("tokens_out"), F.round("cost", 9).alias("cost"))


@query(r"SELECT conv_id, count(*) AS n_hits, min(turn) AS first_turn FROM conversations WHERE role IN ('user', 'assistant') AND regexp_matches(text, '(?i)\bthe\b') GROUP BY conv_id")
def history_search(t):
    return measure.history_search(t("conversations"), "the")


@query(f"""WITH m AS (SELECT conv_id, turn, role, CAST({_WORDS} AS BIGINT) AS tokens, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS ut FROM conversations),
s AS (SELECT conv_id, ut, sum(CASE WHEN role <> 'system' THEN tokens ELSE 0 END) AS t FROM m GROUP BY ALL), f AS (SELECT conv_id, sum(CASE WHEN role = 'system' THEN tokens ELSE 0 END) AS fixed, max(ut) AS last FROM m GROUP BY conv_id),
a AS (SELECT s.*, sum(t) OVER (PARTITION BY s.conv_id ORDER BY ut DESC) AS after, fixed, last FROM s JOIN f USING (conv_id))
SELECT m.conv_id, turn, m.role, tokens FROM m JOIN a ON a.conv_id = m.conv_id AND a.ut = m.ut WHERE role = 'system' OR after + fixed <= 0.8 * 100 OR a.ut = last""")
def context_eviction(t):
    m = t("conversations").select("conv_id", "turn", "role", X.word_count(F.col("text")).cast("long").alias("tokens"))
    return corpus.evict_turns(m, 100).select("conv_id", "turn", "role", "tokens")


@query("""WITH f AS (SELECT conv_id, lower(trim(arg_min(' Plan ' || (length(text) % 7) || ' ', turn))) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT title, count(*) AS versions, max(conv_id) AS latest FROM f GROUP BY title""")
def conversation_versions(t):
    return measure.latest_versions(t("conversations").withColumn("text", F.concat(F.lit(" Plan "), (F.length("text") % 7).cast("string"), F.lit(" "))))


@query("""WITH o AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events),
g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o)
SELECT user_id, min(ts) AS start, max(ts) AS last_ts, count(*) AS n_events, arg_max(event_type, (ts, event_type)) AS last_kind FROM g GROUP BY user_id, s""")
def debounce_events(t):
    return maintain.debounce(t("events"), "30 minutes", "user_id", "ts", "event_type")


@query("""SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type""")
def latency_percentiles(t):
    return measure.nearest_rank(t("events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("SELECT lang AS layer, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def store_statistics(t):
    return corpus.store_stats(t("documents").select(F.col("lang").alias("layer"), "text"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, sha1(source || ':' || doc_id) AS chunk_id, sha256(text) AS file_hash FROM documents")
def content_hashes(t):
    return t("documents").select("doc_id", F.sha1(F.concat_ws(":", "source", F.col("doc_id").cast("string")).cast("binary")).alias("chunk_id"), F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))


@query(r"""WITH d AS (SELECT item_id AS qid, text || ' and the rest or more?' AS query FROM benchmark), a AS (SELECT qid, query, list_transform(regexp_split_to_array(query, '(?i)\s+and\s+'), lambda p: trim(p)) AS parts FROM d)
SELECT qid, array_to_string(list_filter(list_concat([query], parts, flatten(list_transform(parts, lambda p: list_transform(regexp_split_to_array(p, '(?i)\s+or\s+'), lambda x: trim(x))))), lambda x, i: list_position(list_concat([query], parts, flatten(list_transform(parts, lambda p: list_transform(regexp_split_to_array(p, '(?i)\s+or\s+'), lambda x: trim(x))))), x) = i), '|') AS parts FROM a""")
def expand_queries(t):
    q = F.concat("query", F.lit(" and the rest or more?"))
    return _items(t).select("qid", F.array_join(X.expand_query(q), "|").alias("parts"))


_REWRITE = " ".join(f"WHEN contains(lower(q), '{k}') THEN q || ' {m}'" for k, m in X.SYNONYMS)


@query(f"WITH d AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' Deploy' WHEN 1 THEN ' the api error' WHEN 2 THEN ' a/b test' ELSE '' END || '?' AS q FROM conversations) SELECT conv_id, turn, regexp_replace(CASE WHEN contains(q, '/') OR contains(q, ',') THEN q {_REWRITE} ELSE q END, '[?!]+$', '') AS rewritten FROM d")
def rewrite_queries(t):
    return t("conversations").select("conv_id", "turn", X.rewrite_query(F.concat("text", _cycle("turn", " Deploy", " the api error", " a/b test", ""), F.lit("?"))).alias("rewritten"))


@query("""WITH w AS (SELECT conv_id, turn, regexp_replace(lower(string_split(text, ' ')[1]), '[^a-z]', '', 'g') AS word FROM conversations), c AS (SELECT * FROM (VALUES (0, 'search'), (1, 'status'), (2, 'help'), (3, 'history'), (4, 'exit')) AS v(i, c)),
k AS (SELECT conv_id, turn, word, c, row_number() OVER (PARTITION BY conv_id, turn ORDER BY levenshtein(word, c), i) AS r FROM w CROSS JOIN c) SELECT conv_id, turn, c AS command FROM k WHERE r = 1""")
def nearest_command(t):
    word = F.regexp_replace(F.lower(F.get(F.split("text", " "), F.lit(0))), "[^a-z]", "")
    return t("conversations").select("conv_id", "turn", X.nearest(word, ["search", "status", "help", "history", "exit"]).alias("command"))


@query("""SELECT doc_id, CASE WHEN length(text) > 1000 THEN substring(text, 1, 500) || chr(10) || '[... ' || (length(text) - 1000) || ' characters cut ...]' || chr(10) || right(text, 500) ELSE text END AS text FROM documents""")
def middle_truncation(t):
    return t("documents").select("doc_id", X.middle_cut(F.col("text"), 1000).alias("text"))


@query("""WITH p AS (SELECT DISTINCT lang || '/' || source || '/' || doc_id || '.md' AS path FROM documents), n AS (SELECT unnest([string_split(path, '/')[1], string_split(path, '/')[1] || '/' || string_split(path, '/')[2], path]) AS node, unnest([1, 2, 3]) AS depth FROM p)
SELECT DISTINCT node, CAST(depth AS INTEGER) AS depth, depth < 3 AS folder FROM n""")
def path_tree(t):
    return corpus.tree(t("documents").select(F.concat(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")), F.lit(".md")).alias("path"))).select("node", "depth", "folder")


@query("SELECT doc_id, length(text) AS n_chars, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_counts(t):
    return t("documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), X.budget_tokens(F.col("text")).alias("tokens"))


@query()
def document_structure(t):
    return structure.detect_structure(_docs(t)).select("id", "chapters", "method", F.array_join("sample", "|").alias("sample"), "has_toc")


_TOC_LINES = "|".join(structure.CONTENTS)


@query(f"SELECT doc_id AS id, regexp_matches(substring(coalesce(text, ''), 1, 30000), '(?im)^\\s*(?:{_TOC_LINES}|目[ \\t\\x{{3000}}]*(?:录|錄|次))\\s*$') AS has_toc FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'A title' || chr(10) || ' Contents ' || chr(10) ELSE '' END || text || CASE doc_id % 3 WHEN 1 THEN chr(10) || 'SOMMARIO' ELSE ' contents' END AS text FROM documents)")
def contents_pages(t):
    text = F.concat(_cycle("id", "A title\n Contents \n", "", ""), "text", _cycle("id", " contents", "\nSOMMARIO", " contents"))
    return _docs(t).select("id", structure.has_contents(text).alias("has_toc"))


_PLAN = ", ".join(f"CASE WHEN NOT regexp_matches(coalesce(text, ''), '(?im)^#+\\s*.*{x}') THEN '{x}' END" for x in structure.PLAN_SECTIONS)


@query(f"""SELECT conv_id, turn, array_to_string([{_PLAN}], '|') AS missing
FROM (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN chr(10) || '## Open Questions' || chr(10) || '# 2. verification plan' WHEN 1 THEN chr(10) || 'Open Questions' ELSE chr(10) || '### Proposed Changes' END AS text FROM conversations)""")
def plan_sections(t):
    return t("conversations").select("conv_id", "turn", F.array_join(structure.missing_sections(F.concat("text", _cycle("turn", "\n## Open Questions\n# 2. verification plan", "\nOpen Questions", "\n### Proposed Changes"))), "|").alias("missing"))


_PATHS = "lang || '/' || source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.HPP' ELSE '' END"


@query(f"""WITH p AS (SELECT doc_id, {_PATHS} AS path FROM documents) SELECT doc_id, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'md' THEN 'markdown' WHEN 'hpp' THEN 'cpp' END AS language FROM p""")
def file_languages(t):
    ending = F.get(F.array(F.lit(".py"), F.lit(".md"), F.lit(".HPP"), F.lit("")), (F.col("doc_id") % 4).cast("int"))
    path = F.concat(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")), ending)
    return t("documents").select("doc_id", code.language(path).alias("language"))


@query()
def page_markdown(t):
    return markdown.markdown_column(t("pages")).select("page_id", "markdown", F.length("markdown").alias("n_chars"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 3)) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM s),
u AS (SELECT vec_id, norm, CASE WHEN norm > 0 THEN list_transform(v, lambda x: x / norm) ELSE v END AS u FROM n)
SELECT vec_id, norm > 0 AS has_length, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS squared, round(u[1], 6) + 0.0 AS head FROM u""")
def unit_vectors(t):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3))
    v = t("embeddings").select("vec_id", X.unit_vector(scaled).alias("u"))
    squared = F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)
    return v.select("vec_id", (squared > 0).alias("has_length"), F.round(squared, 6).alias("squared"), (F.round(F.get("u", F.lit(0)), 6) + 0.0).alias("head"))


@query(r"SELECT doc_id AS id, length(coalesce(text, '')) AS n_chars, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, round(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_full_match(s, '[\s\x{0B}\x{85}\p{Z}]*'))) / len(string_split(coalesce(text, ''), chr(10))), 2) AS blank_density, length(coalesce(text, '')) > 0 AS ok FROM documents")
def extraction_density(t):
    return assess.extraction_density(_docs(t))


@query(f"WITH {_BM25}, h AS (SELECT qid, id, rank AS was FROM rk WHERE rank <= 10), s AS (SELECT h.qid, h.id, was, len(list_intersect(list_distinct({_tokens_sql('b.text')}), list_distinct({_tokens_sql('d.text')})))::DOUBLE AS rerank_score FROM h JOIN benchmark b ON b.item_id = h.qid JOIN documents d ON d.doc_id = h.id) SELECT qid, id, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, was) AS rank FROM s")
def reranked_search(t):
    found = _sparse(t, 10).join(_docs(t), "id").join(_items(t), "qid")
    shared = lambda q, d: F.size(F.array_intersect(X.tokens(q), X.tokens(d)))
    return assess.rerank(found, shared).select("qid", "id", "rerank_score", "rank")


@query("""SELECT doc_id, regexp_replace(text, '[' || chr(8203) || '-' || chr(8207) || chr(8288) || '-' || chr(8292) || chr(8294) || '-' || chr(8297) || chr(8234) || '-' || chr(8238) || chr(65279) || chr(173) || chr(847) || chr(6158) || chr(1564) || chr(4447) || chr(4448) || chr(12644) || chr(65440) || chr(917504) || '-' || chr(917631) || ']', '', 'g') AS clean
FROM (SELECT doc_id, text || chr(8203) || 'a' || chr(173) || chr(4447) || 'b' || chr(917569) || chr(65279) AS text FROM documents)""")
def sanitized_texts(t):
    return t("documents").select("doc_id", X.sanitize(F.concat("text", F.lit("\u200ba\u00ad\u115fb\U000e0041\ufeff"))).alias("clean"))


@query("SELECT doc_id, 1 + length(left(text, n)) - length(replace(left(text, n), chr(10), '')) AS line FROM (SELECT doc_id, text, length(text) // 2 AS n FROM documents)")
def middle_line(t):
    return t("documents").select("doc_id", corpus.line_of_offset(F.col("text"), F.floor(F.length("text") / 2)).cast("long").alias("line"))
