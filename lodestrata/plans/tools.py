"""Registered queries of search with all its arguments, file search, paging, audits and names, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus, measure, search
from ..sources import files
from ..streaming import live_index
from .queries import _BM25, _COS, _DENSE_ITEMS, _MSG, _REWRITE, _WORDS, _cycle, _docs, _items, _tokens_sql, _vectors, query

_N = 'CAST(row_number() OVER (PARTITION BY qid ORDER BY {}) AS INTEGER) AS rank'


def _about(t):
    return t("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("layer"), F.col("source").alias("namespace"), X.budget_tokens(F.col("text")).alias("tokens"))


def _with_vectors(t):
    return _items(t).join(_vectors(t).select(F.col("id").alias("qid"), F.col("v").alias("qv")), "qid", "left")


def _shown(got, *more):
    return got.select("qid", "id", "rank", F.round("score", 6).alias("score"), *more)


def _scored_sql(asked: str, key: str) -> str:
    """BM25 of other queries than the benchmark's own: asked has the columns of key and query."""
    return f"""qq AS (SELECT {key}, term, count(*) AS qtf FROM (SELECT {key}, unnest({_tokens_sql('query')}) AS term FROM {asked}) GROUP BY ALL),
ss AS (SELECT {key}, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) AS score FROM qq JOIN df USING (term) JOIN tf USING (term) CROSS JOIN st GROUP BY {key}, id),
sr AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(score, 9) DESC, id) AS rank FROM ss)"""


# a query, its parts between "and", theirs between "or"; the best score of any part counts, so repeated parts don't matter
_PARTS = f"""ands AS (SELECT item_id AS qid, text AS query, unnest(regexp_split_to_array(text, '(?i)\\s+and\\s+')) AS p FROM benchmark),
ex AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY query) AS part, query FROM (SELECT qid, query FROM ands UNION SELECT qid, trim(p) FROM ands UNION SELECT qid, trim(unnest(regexp_split_to_array(p, '(?i)\\s+or\\s+'))) FROM ands))"""
_EXPANDED = f"""{_BM25}, {_PARTS}, {_scored_sql('ex', 'qid, part')}, sm AS (SELECT qid, id, max(score) AS bs FROM sr WHERE rank <= 50 GROUP BY qid, id)"""
_FUSED = """f AS (SELECT coalesce(s.qid, d.qid) AS qid, coalesce(s.id, d.id) AS id, bs, dsc, br, dr, coalesce(1 / (60.0 + dr), 0) + coalesce(1 / (60.0 + br), 0) AS rrf, coalesce(dsc, 1 - 1 / (1 + bs), 0) AS score FROM s FULL JOIN d ON s.qid = d.qid AND s.id = d.id),
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, dr NULLS LAST, br NULLS LAST, id) AS rank FROM f)"""
_SPARSE_RANKED = "s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bs, 9) DESC, id) AS br FROM sm)"


def _budget_sql(rows: str, budget: int) -> str:
    """Greedy by rank over all of rows (qid, id, r, tokens, ...): what doesn't fit is skipped, the first stays in any case; then five are shown."""
    return f"""w AS (SELECT qid, r, true AS kept, tokens AS used FROM {rows} WHERE r = 1
UNION ALL SELECT m.qid, m.r, w.used + m.tokens <= {budget}, CASE WHEN w.used + m.tokens <= {budget} THEN w.used + m.tokens ELSE w.used END FROM w JOIN {rows} m ON m.qid = w.qid AND m.r = w.r + 1),
k AS (SELECT m.*, row_number() OVER (PARTITION BY m.qid ORDER BY m.r) AS place, count(*) OVER (PARTITION BY m.qid) AS n_kept FROM {rows} m JOIN w ON w.qid = m.qid AND w.r = m.r AND kept),
c AS (SELECT qid, count(*) AS n FROM {rows} GROUP BY qid)"""


@query(f"""WITH {_EXPANDED}, l AS (SELECT qid, sm.id, bs, row_number() OVER (PARTITION BY qid ORDER BY round(bs, 9) DESC, sm.id) AS rank FROM sm JOIN documents d ON d.doc_id = sm.id WHERE lang = 'en' AND source = 'src1'),
m AS (SELECT * FROM l WHERE 1 - 1 / (1 + bs) >= 0.9), r AS (SELECT qid, id, {_N.format('rank')}, round(1 - 1 / (1 + bs), 6) AS score FROM m) SELECT * FROM r WHERE rank <= 5""")
def search_keyword(t):
    return _shown(search.search(_items(t), "keyword", index=search.build_index(_docs(t), queries=_items(t)), about=_about(t), layer="en", namespace="src1", min_score=0.9))


_COSINE = _DENSE_ITEMS.replace("FROM e q JOIN e c ON", "FROM e q JOIN e c ON c.id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND")


@query(f"WITH {_COSINE}, m AS (SELECT qid, id, {_N.format('rank')}, score FROM dk WHERE rank <= 50 AND score >= 0.1) SELECT qid, id, rank, round(score, 6) AS score FROM m WHERE rank <= 5")
def search_dense(t):
    return _shown(search.search(_with_vectors(t), "dense", vectors=_vectors(t).drop("namespace"), about=_about(t), layer="en", min_score=0.1))


@query(f"""WITH RECURSIVE {_EXPANDED}, {_SPARSE_RANKED}, {_DENSE_ITEMS}, d AS (SELECT qid, id, score AS dsc, rank AS dr FROM dk WHERE rank <= 50), {_FUSED},
g AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM h WHERE score >= 0.2), m AS (SELECT g.*, coalesce(CAST(ceil(length(d.text) / 4.0) AS BIGINT), 0) AS tokens FROM g LEFT JOIN documents d ON d.doc_id = g.id), {_budget_sql('m', 900)}
SELECT qid, id, CAST(place AS INTEGER) AS rank, round(score, 6) AS score, n - n_kept AS truncated FROM k JOIN c USING (qid) WHERE place <= 5""")
def search_hybrid(t):
    got = search.search(_with_vectors(t), index=search.build_index(_docs(t), queries=_items(t)), vectors=_vectors(t).drop("namespace"), about=_about(t), min_score=0.2, max_tokens=1000)
    return _shown(got, "truncated")


# a query has two vectors, its own and the next one's; of benchmark items without any the dense side is empty
_TWO_VECTORS = f"""e AS (SELECT vec_id AS id, embedding AS v FROM embeddings), qs AS (SELECT item_id AS qid, item_id AS id FROM benchmark WHERE item_id % 3 <> 0 UNION ALL SELECT item_id, item_id + 1 FROM benchmark WHERE item_id % 3 <> 0),
ds AS (SELECT qs.qid, qs.id AS part, c.id, {_COS} AS score FROM qs JOIN e q ON q.id = qs.id CROSS JOIN e c), dk AS (SELECT *, row_number() OVER (PARTITION BY qid, part ORDER BY round(score, 9) DESC, id) AS rank FROM ds),
dm AS (SELECT qid, id, max(score) AS dsc FROM dk WHERE rank <= 50 GROUP BY qid, id), d AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dsc, 9) DESC, id) AS dr FROM dm)"""


@query(f"""WITH RECURSIVE {_EXPANDED}, {_SPARSE_RANKED}, {_TWO_VECTORS}, {_FUSED},
x AS (SELECT h.*, b.text AS query, doc.text, doc.source FROM h JOIN benchmark b ON b.item_id = h.qid LEFT JOIN documents doc ON doc.doc_id = h.id WHERE rank <= 10),
y AS (SELECT *, CAST(len(list_intersect(list_distinct({_tokens_sql('query')}), list_distinct({_tokens_sql('text')}))) AS DOUBLE) AS rs FROM x),
m AS (SELECT qid, id, score, rs, source, row_number() OVER (PARTITION BY qid ORDER BY rs DESC, rank) AS r, coalesce(CAST(ceil(length(text) / 4.0) AS BIGINT), 0) AS tokens FROM y), {_budget_sql('m', 1800)}
SELECT qid, id, CAST(place AS INTEGER) AS rank, round(score, 6) AS score, rs AS rerank_score, coalesce(source, '') AS namespace, n - n_kept AS truncated FROM k JOIN c USING (qid) WHERE place <= 5""")
def search_reranked(t):
    v = _vectors(t).drop("namespace")
    own = _items(t).where("qid % 3 <> 0").select("qid", F.explode(F.array(F.col("qid"), F.col("qid") + 1)).alias("id")).join(v.withColumnRenamed("v", "qv"), "id").select("qid", "qv")
    queries = _items(t).join(own, "qid", "left")
    shared = lambda q, d: F.size(F.array_intersect(X.tokens(q), X.tokens(d)))
    about = _about(t).join(_docs(t), "id")
    got = search.search(queries, index=search.build_index(_docs(t), queries=_items(t)), vectors=v, about=about, max_tokens=2000, scorer=shared)
    return _shown(got, "rerank_score", F.coalesce("namespace", F.lit("")).alias("namespace"), "truncated")


@query(f"""WITH {_BM25}, a AS (SELECT item_id AS qid, words[1] || ' ' || words[2] AS one, words[3] || ' ' || words[4] AS two FROM (SELECT item_id, string_split(replace(text, chr(10), ' '), ' ') AS words FROM benchmark)),
asked AS (SELECT qid, part, query FROM (SELECT qid, unnest([1, 2, 3]) AS part, unnest([one || ' and ' || two, one, two]) AS query FROM a)), {_scored_sql('asked', 'qid, part')},
b AS (SELECT qid, id, max(score) AS score FROM sr WHERE rank <= 50 GROUP BY qid, id), o AS (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, round(score, 6) AS score FROM b)
SELECT * FROM o WHERE rank <= 10""")
def expanded_search(t):
    words = F.split(F.replace("query", F.lit("\n"), F.lit(" ")), " ")
    asked = _items(t).select("qid", F.concat_ws(" ", words[0], words[1], F.lit("and"), words[2], words[3]).alias("query"))
    index = search.build_index(_docs(t), queries=asked)
    return search.merged_subqueries(asked, lambda q: search.bm25(q, index, search.CANDIDATES), 10).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {_BM25}, first AS (SELECT item_id AS qid, string_split(replace(text, chr(10), ' '), ' ')[1] || ' ' || CASE item_id % 3 WHEN 0 THEN 'deploy' WHEN 1 THEN 'error' ELSE 'and/or' END || '?' AS query FROM benchmark),
asked AS (SELECT qid, 1 AS iterations, query FROM first UNION ALL SELECT qid, 2, regexp_replace(CASE WHEN contains(q, '/') OR contains(q, ',') THEN q {_REWRITE} ELSE q END, '[?!]+$', '') FROM (SELECT qid, query AS q FROM first)),
{_scored_sql('asked', 'qid, iterations')}, tops AS (SELECT qid, iterations, 1 - 1 / (1 + score) AS top FROM sr WHERE rank = 1),
use AS (SELECT f.qid, CASE WHEN coalesce(t.top, 0) < 0.8 THEN 2 ELSE 1 END AS iterations FROM first f LEFT JOIN tops t ON t.qid = f.qid AND t.iterations = 1)
SELECT sr.qid, CAST(sr.iterations AS INTEGER) AS iterations, sr.id, CAST(rank AS INTEGER) AS rank, round(1 - 1 / (1 + score), 6) AS score, round(top, 6) AS top_score, top < 0.8 AS low_confidence
FROM sr JOIN use ON use.qid = sr.qid AND use.iterations = sr.iterations JOIN tops ON tops.qid = sr.qid AND tops.iterations = sr.iterations WHERE rank <= 5""")
def retrieve_loop(t):
    words = F.split(F.replace("query", F.lit("\n"), F.lit(" ")), " ")
    asked = _items(t).select("qid", F.concat(words[0], F.lit(" "), _cycle("qid", "deploy", "error", "and/or"), F.lit("?")).alias("query"))
    index = search.build_index(_docs(t), queries=asked.union(asked.select("qid", X.rewrite_query(F.col("query")).alias("query"))))
    got = search.retrieve(asked, lambda q: search.search(q, "keyword", index=index).select("qid", "id", "score", "rank"), 0.8)
    return got.select("qid", "iterations", "id", "rank", F.round("score", 6).alias("score"), F.round("top_score", 6).alias("top_score"), "low_confidence")


@query(f"""WITH {_BM25}, l AS (SELECT qid, id, rank FROM rk WHERE rank <= 20 UNION ALL SELECT qid, id, 21 - rank FROM rk WHERE rank <= 20 AND id % 2 = 0 UNION ALL SELECT qid, id, id % 7 + 1 FROM rk WHERE rank <= 20)
SELECT qid, id, round(sum(1 / (10.0 + rank)), 9) AS rrf FROM l GROUP BY qid, id""")
def rrf_lists(t):
    one = search.bm25(_items(t), search.build_index(_docs(t), queries=_items(t)), 20)
    lists = [one, one.where("id % 2 = 0").withColumn("rank", 21 - F.col("rank")), one.withColumn("rank", F.col("id") % 7 + 1)]
    return search.rrf(lists, 10).select("qid", "id", F.round("rrf", 9).alias("rrf"))


# files made of documents: every fifth is binary, and texts over 8,000 bytes are too large
_FILES = """f AS (SELECT doc_id AS id, lang || '/' || source || '/' || doc_id || CASE doc_id % 2 WHEN 0 THEN '.md' ELSE '.txt' END AS path, text, doc_id % 5 = 0 OR octet_length(encode(text)) > 8000 AS skipped FROM documents),
c AS (SELECT * FROM f WHERE path LIKE 'en/%.md'), d AS (SELECT id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM c WHERE NOT skipped),
h AS (SELECT id, ls, unnest(generate_series(1, len(ls))) AS n FROM d), g AS (SELECT * FROM h WHERE contains(ls[n], 'tion'))"""


def _files(t):
    path = F.concat(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")), _cycle("doc_id", ".md", ".txt"))
    nul = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\x00"), "text")).otherwise(F.col("text"))
    return t("documents").select(F.col("doc_id").alias("id"), path.alias("path"), nul.alias("text"))


@query(f"WITH {_FILES} SELECT id, CAST(n AS INTEGER) AS line_number, ls[n] AS line, array_to_string(list_slice(ls, greatest(1, n - 1), least(len(ls), n + 1)), chr(10)) AS context FROM g ORDER BY id, n LIMIT 40")
def grep_files(t):
    return corpus.grep_files(_files(t), "tion", "en/**.md", context=1, limit=40, max_bytes=8000)[0]


@query(f"WITH {_FILES} SELECT (SELECT count(*) FROM g) AS matches, (SELECT count(*) FROM c WHERE NOT skipped) AS searched, (SELECT count(*) FROM c WHERE skipped) AS skipped, (SELECT count(*) FROM g) > 40 AS truncated")
def grep_totals(t):
    return corpus.grep_files(_files(t), "tion", "en/**.md", limit=40, max_bytes=8000)[1]


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), h AS (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS hit FROM d),
c AS (SELECT doc_id, ls, hit, unnest(generate_series(greatest(1, hit - 1), least(len(ls), hit + 1))) AS n FROM h WHERE contains(ls[hit], 'Than'))
SELECT doc_id AS id, CAST(hit AS INTEGER) AS hit, CAST(n AS INTEGER) AS line_number, ls[n] AS line, n = hit AS is_match FROM c""")
def grep_context(t):
    return corpus.grep_context(_docs(t), "Than", context=1)


@query("""WITH p AS (SELECT DISTINCT lang || '/' || CASE doc_id % 2 WHEN 0 THEN source || '/' ELSE 'S' END || doc_id || '.md' AS path FROM documents), s AS (SELECT string_split(path, '/') AS parts FROM p),
n AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS node, array_to_string(parts[1:i - 1], '/') AS parent, parts[i] AS name, i < len(parts) AS folder FROM (SELECT parts, unnest(generate_series(1, len(parts))) AS i FROM s))
SELECT node, folder, CAST(row_number() OVER (PARTITION BY parent ORDER BY folder DESC, lower(name), name) AS INTEGER) AS place FROM n""")
def tree_order(t):
    inner = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("/"))).otherwise(F.lit("S"))
    paths = t("documents").select(F.concat("lang", F.lit("/"), inner, F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return corpus.tree_order(corpus.tree(paths)).select("node", "folder", "place")


@query("SELECT doc_id, namespace FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN replace(source, 'src', 's%c_') ELSE source END AS namespace FROM documents) WHERE namespace IS NULL OR NOT starts_with(namespace, 's%c_')")
def namespace_delete(t):
    name = F.when(F.col("doc_id") % 3 == 1, F.replace("source", F.lit("src"), F.lit("s%c_"))).when(F.col("doc_id") % 3 == 2, F.col("source"))
    return corpus.without_namespace(t("documents").select("doc_id", name.alias("namespace")), "s%c_")


@query("""WITH p AS (SELECT doc_id AS id, generate_subscripts(string_split(text, chr(10)), 1) AS page, unnest(string_split(text, chr(10))) AS text FROM documents),
c AS (SELECT id, page, sum(length(text)) OVER (PARTITION BY id ORDER BY page) + 2 * (row_number() OVER (PARTITION BY id ORDER BY page) - 1) AS upto FROM p)
SELECT id, CAST(max(upto) AS BIGINT) AS total_chars, CAST(coalesce(min(page) FILTER (WHERE upto > 1500), 0) AS INTEGER) AS truncated_at FROM c GROUP BY id""")
def page_of_limit(t):
    pages = corpus.lines(_docs(t)).select("id", F.col("line_number").alias("page"), F.col("line").alias("text"))
    return corpus.page_of_limit(pages, 1500).withColumn("truncated_at", F.coalesce("truncated_at", F.lit(0)))


@query(r"SELECT conv_id, count(*) AS n_hits, min(turn) AS first_turn FROM conversations WHERE role IN ('user', 'assistant') AND regexp_matches(text, '(?i)\bthe\b') GROUP BY conv_id ORDER BY conv_id DESC LIMIT 5 OFFSET 10")
def history_page(t):
    return corpus.page_of_rows(measure.history_search(t("conversations"), "the"), 3, F.desc("conv_id"))


@query(f"""SELECT count(*) AS sources, CAST(sum(1 + doc_id % 4) AS BIGINT) AS pages, round(sum(length(text) / 1e6), 2) AS size_mb, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({_WORDS}) AS BIGINT) AS words,
CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, bool_or(doc_id % 4 = 1) AS has_toc FROM documents""")
def corpus_sums(t):
    return corpus.corpus_sums(t("documents").select("text", (1 + F.col("doc_id") % 4).alias("pages"), (F.length("text") / 1e6).alias("size_mb"), (F.col("doc_id") % 4 == 1).alias("has_toc")))


# every assistant turn calls one tool, and every fifth turn is condensed
_AUDIT = f"""m AS (SELECT conv_id, turn, role, turn % 5 = 4 AS condensed, {_MSG} AS t FROM conversations),
a AS (SELECT conv_id, t + CASE WHEN role = 'assistant' AND NOT condensed THEN 1.6 + 1.6 + 10 / 4.0 * 1.6 + 12 ELSE 0 END AS i, CASE WHEN role = 'assistant' AND NOT condensed THEN t + 1.6 + 1.6 + 10 / 4.0 * 1.6 + 12 ELSE 0 END AS o FROM m),
u AS (SELECT conv_id, CAST(floor(round(sum(i), 6)) AS BIGINT) AS tokens_in, CAST(floor(round(sum(o), 6)) AS BIGINT) AS tokens_out FROM a GROUP BY conv_id)"""


def _audited(t):
    call = F.array(F.struct(F.lit("call_1").alias("id"), F.lit("grep").alias("name"), F.lit('{"q": "x"}').alias("arguments")))
    m = t("conversations").withColumns({"condensed": F.col("turn") % 5 == 4, "call_id": F.lit(None).cast("string"), "name": F.lit(None).cast("string"), "tool_calls": F.when(F.col("role") == "assistant", call)})
    return measure.audit(m)


@query(f"WITH {_AUDIT} SELECT * FROM u")
def conversation_audit(t):
    return _audited(t)


@query(f"WITH {_AUDIT} SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'other' END AS model, round((tokens_in * CASE conv_id % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 2.0 ELSE 0.3 END + tokens_out * CASE conv_id % 3 WHEN 0 THEN 0.4 WHEN 1 THEN 8.0 ELSE 1.1 END + tokens_in * CASE conv_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 0.2 END) / 1e6, 9) AS cost FROM u")
def audit_cost(t):
    usage = _audited(t).withColumns({"model": _cycle("conv_id", "small", "large", "other"), "tokens_missed": F.col("tokens_in")})
    prices = usage.sparkSession.createDataFrame([("small", 0.1, 0.4, 0.0), ("large", 2.0, 8.0, 0.5)], "model string, rate_in double, rate_out double, rate_missed double")
    return measure.audit_cost(usage, prices, (0.3, 1.1, 0.2)).select("conv_id", "model", F.round("cost", 9).alias("cost"))


@query("""WITH c AS (SELECT conv_id, 'c' || turn AS call_id, length(text) AS n FROM conversations WHERE role = 'assistant'), r AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'user')
SELECT c.conv_id, c.call_id, n, coalesce(length(r.text), -1) AS answered FROM c LEFT JOIN r USING (conv_id, call_id)""")
def answered_calls(t):
    c = t("conversations")
    calls = c.where("role = 'assistant'").select("conv_id", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("call_id"), F.length("text").cast("long").alias("n"))
    answers = c.where("role = 'user'").select("conv_id", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"), "text")
    return measure.answered_calls(calls, answers).select("conv_id", "call_id", "n", F.coalesce(F.length("text"), F.lit(-1)).cast("long").alias("answered"))


@query(r"""WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' .a<b>: "c"--' WHEN 1 THEN 'x/y\z|?*  ' ELSE '' END || left(text, 45) || ' -. ' AS raw FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '[<>:"/\\|?*]', '-', 'g'), '\s+', ' ', 'g'), '-+', '-', 'g'), '^[.\s-]+|[.\s-]+$', '', 'g') AS c FROM r)
SELECT doc_id, CASE WHEN length(c) > 50 THEN regexp_replace(left(c, 50), '[.\s-]+$', '') ELSE c END AS name FROM c""")
def file_names(t):
    raw = F.concat(_cycle("doc_id", ' .a<b>: "c"--', "x/y\\z|?*  ", ""), F.substring("text", 1, 45), F.lit(" -. "))
    return t("documents").select("doc_id", X.file_name(raw).alias("name"))


@query("SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN 'Untitled Conversation' WHEN length(t) > 60 THEN left(t, 57) || '...' ELSE t END AS title FROM (SELECT conv_id, turn, CASE turn % 2 WHEN 0 THEN text ELSE left(text, 60) END AS t FROM conversations)")
def short_titles(t):
    text = F.when(F.col("turn") % 7 == 6, F.lit(None).cast("string")).otherwise(F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.substring("text", 1, 60)))
    return t("conversations").select("conv_id", "turn", X.short_title(text).alias("title"))


@query("""WITH m AS (SELECT conv_id, list(DISTINCT 'f' || (length(text) % 9)) AS modified, list(DISTINCT 'f' || (turn % 4)) AS created FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_sort(list_filter(modified, lambda f: NOT list_contains(created, f))), '|') AS changed FROM m""")
def changed_only(t):
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    m = t("conversations").groupBy("conv_id").agg(F.collect_set(name(F.length("text") % 9)).alias("modified"), F.collect_set(name(F.col("turn") % 4)).alias("created"))
    return m.select("conv_id", F.array_join(X.changed_only(F.col("modified"), F.col("created")), "|").alias("changed"))


# known hashes differ for every third document, and every seventh isn't known yet
@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0")
def changed_files(t):
    live = t("documents").select(F.col("lang").alias("layer"), F.col("doc_id").alias("path"), F.sha2("text", 256).alias("file_hash"))
    known = live.where("path % 7 <> 0").withColumn("file_hash", F.when(F.col("path") % 3 == 0, F.lit("old")).otherwise(F.col("file_hash")))
    return corpus.changed_files(live, known)[0].select(F.col("path").alias("doc_id"))


@query(r"""WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{"a": "' || w WHEN 1 THEN '{"a": {"b": [1, 2' || ']' WHEN 2 THEN '{"a": "x\"{' || w || '", "b": {"c": 1' WHEN 3 THEN '["' || w ELSE '{"a": ' END AS raw FROM (SELECT doc_id, regexp_extract(text, '[A-Za-z]+') AS w FROM documents)),
c AS (SELECT doc_id, raw || CASE WHEN contains(regexp_replace(raw, '(?s)"(?:\\.|[^"\\])*"', '', 'g'), '"') THEN '"' ELSE '' END AS closed FROM r), o AS (SELECT *, regexp_replace(closed, '(?s)"(?:\\.|[^"\\])*"', '', 'g') AS outside FROM c),
f AS (SELECT doc_id, closed || repeat('}', greatest(0, len(string_split(outside, '{')) - len(string_split(outside, '}')))) || repeat(']', greatest(0, len(string_split(outside, '[')) - len(string_split(outside, ']')))) AS full FROM o)
SELECT doc_id, CASE WHEN json_valid("full") THEN "full" END AS json FROM f""")
def repaired_json(t):
    w = F.regexp_extract("text", "[A-Za-z]+", 0)
    n = F.col("doc_id") % 5
    raw = F.when(n == 0, F.concat(F.lit('{"a": "'), w)).when(n == 1, '{"a": {"b": [1, 2]').when(n == 2, F.concat(F.lit('{"a": "x\\"{'), w, F.lit('", "b": {"c": 1'))).when(n == 3, F.concat(F.lit('["'), w)).otherwise('{"a": ')
    return t("documents").select("doc_id", X.repaired_json(raw).alias("json"))


@query(r"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN left(replace(text, '`', ''), 40) WHEN 1 THEN regexp_replace(left(replace(text, '`', ''), 20), '\n$', '') END AS block FROM documents WHERE text <> ''")
def fenced_blocks(t):
    head = lambda n: F.substring(F.replace("text", F.lit("`"), F.lit("")), 1, n)
    n = F.col("doc_id") % 3
    text = F.when(n == 0, F.concat(F.lit("Here:\n```json\n"), head(40), F.lit("\n```\nand ```json\n2\n```"))).when(n == 1, F.concat(F.lit("```\n"), head(20), F.lit("```"))).otherwise(F.concat(F.lit("```json"), head(20)))
    return t("documents").where("text <> ''").select("doc_id", X.fenced_block(text).alias("block"))


@query("SELECT doc_id, starts_with(source, 'src1') AND (contains(lower(text), 'tion') OR contains(lower(text), 'than')) AS any_term, contains(lower(text), 'tion') AND contains(lower(text), 'than') AS all_terms FROM documents")
def relevant_results(t):
    terms = F.array(F.lit("TION"), F.lit("Than"))
    path = F.concat(F.lit("books/"), F.col("source"), F.lit(".md"))
    return t("documents").select("doc_id", X.relevant(path, F.col("text"), F.lit("/src1"), terms).alias("any_term"), X.relevant(path, F.col("text"), F.lit(None).cast("string"), terms, True).alias("all_terms"))


@query(f"""WITH {_BM25}, r AS (SELECT qid, CAST(sum(ceil(length(d.text) / 4.0)) AS BIGINT) AS t FROM rk JOIN documents d ON d.doc_id = rk.id WHERE rank <= 5 GROUP BY qid), s AS (SELECT CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS whole FROM documents WHERE source = 'src1')
SELECT item_id AS qid, coalesce(t, 0) + 60 AS tokens_with, whole AS tokens_without, round((1 - (coalesce(t, 0) + 60) / whole::DOUBLE) * 100, 6) AS savings FROM benchmark LEFT JOIN r ON r.qid = item_id CROSS JOIN s""")
def token_savings(t):
    sizes = _about(t)
    whole = sizes.where("namespace = 'src1'").agg(F.sum("tokens").alias("tokens")).withColumn("one", F.lit(1))
    sources = _items(t).select("qid", F.lit(1).alias("one")).join(whole, "one").select("qid", "tokens")
    got = search.bm25(_items(t), search.build_index(_docs(t), queries=_items(t)), 5).join(sizes.select("id", "tokens"), "id")
    return measure.token_savings(got, sources).withColumn("savings", F.round("savings", 6))


@query(f"""WITH {_BM25}, r AS (SELECT qid, max(1 - 1 / (1 + score)) AS best, sum(ceil(length(d.text) / 4.0)) AS t FROM rk JOIN documents d ON d.doc_id = rk.id WHERE rank <= 5 GROUP BY qid)
SELECT count(*) AS n, round(avg(CASE WHEN coalesce(best, 0) < 0.98 THEN 1.0 ELSE 0.0 END), 6) AS low_confidence, round(avg(coalesce(t, 0)), 6) AS mean_tokens FROM benchmark LEFT JOIN r ON r.qid = item_id""")
def search_confidence(t):
    got = search.bm25(_items(t), search.build_index(_docs(t), queries=_items(t)), 5).join(_about(t).select("id", "tokens"), "id").withColumn("score", X.saturation(F.col("score")))
    m = measure.confidence(got, _items(t), 0.98)
    return m.select("n", F.round("low_confidence", 6).alias("low_confidence"), F.round("mean_tokens", 6).alias("mean_tokens"))


@query(f"""WITH {_BM25}, r AS (SELECT qid, rk.id, rank, source, text FROM rk JOIN documents d ON d.doc_id = rk.id WHERE rank <= 5), b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY source <> 'src' || qid % 4, rank) AS place FROM r)
SELECT item_id AS qid, coalesce(id, -1) AS id, CASE WHEN length(b.text) > 500 THEN left(b.text, 500) || '...' ELSE b.text END AS answer FROM benchmark LEFT JOIN b ON b.qid = item_id AND place = 1""")
def plain_answers(t):
    found = search.bm25(_items(t), search.build_index(_docs(t), queries=_items(t)), 5).join(t("documents").select(F.col("doc_id").alias("id"), F.concat(F.col("source"), F.lit("/x.md")).alias("file_path"), "text"), "id")
    expected = _items(t).select("qid", F.concat(F.lit("src"), (F.col("qid") % 4).cast("string"), F.lit("/")).alias("source"))
    return measure.plain_answers(found, expected).withColumn("id", F.coalesce("id", F.lit(-1)))


# an index of two thirds of the documents, then a batch with the others, with halves of every fifth and without every seventh
_LIVE = f"""now AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN left(text, length(text) // 2) ELSE text END AS text, lang FROM documents WHERE doc_id % 7 <> 3), t AS (SELECT id, {_tokens_sql('text')} AS ts FROM now)"""


def _live(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), "text")
    index = live_index.LiveIndex(docs.sparkSession, files.scratch_folder(docs.sparkSession, "live"), buckets=8)
    index.apply(docs.where("id % 3 <> 2"))
    halves = docs.withColumn("text", F.when(F.col("id") % 5 == 0, F.left("text", F.floor(F.length("text") / 2))).otherwise(F.col("text")))
    index.apply(halves.where("id % 3 = 2 OR id % 5 = 0"), docs.where("id % 7 = 3").select("id"))
    return index


_LIVE_BM25 = _BM25.replace(_BM25[: _BM25.index("st AS")], f"\n{_LIVE},\n")


@query(f"WITH {_LIVE_BM25} SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM rk WHERE rank <= 10")
def live_search(t):
    return _shown(search.bm25(_items(t), _live(t).index(_items(t)), 10))


@query(f"WITH {_LIVE_BM25} SELECT df.term, df, CAST(sum(tf) AS BIGINT) AS cf FROM df JOIN tf USING (term) GROUP BY ALL")
def live_terms(t):
    index = _live(t)
    index.compact()
    index.vacuum()
    i = index.index()
    return i.postings.groupBy("term").agg(F.sum("tf").alias("cf")).join(i.terms, "term").select("term", "df", "cf")
