"""Ranking for tables of queries: BM25, cosine, reciprocal-rank fusion, hybrid search, confidence-gated retry, token budgets.

Every operator takes many queries at once and returns one lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .nearest import nearest

K1, B, RRF_K, CANDIDATES = 1.5, 0.75, 60, 50
#: Queries of at most so many characters together are broadcast; more are joined by a shuffle.
SMALL_QUERIES = 16_000_000
#: Bytes of texts that a task of an index takes: the scores of its texts for all queries are summed in its memory.
TEXTS = 8 << 20


@dataclass
class Index:
    """Inverted index: postings (term, id, tf, dl) and terms (term, df), with corpus size and mean length."""

    postings: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    kept: DataFrame | None = None  # what the postings are read from, if not kept themselves

    def release(self) -> None:
        """Give up the kept postings, once nothing reads the index any more."""
        (self.postings if self.kept is None else self.kept).unpersist()

    def save(self, path: str) -> None:
        """Snapshot: postings sorted by term within files, so a term's row groups are found by their statistics."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.postings.sparkSession.createDataFrame([(self.n, self.avgdl)], "n long, avgdl double").write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark, path: str) -> Index | None:
        """A snapshot, or None if it is missing or damaged."""
        try:
            s = spark.read.parquet(f"{path}/stats").first()
            return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), s.n, s.avgdl)
        except Exception:  # any damage means rebuild
            return None


def tasks(texts: DataFrame, most: int) -> int:
    """How many tasks texts are dealt to: one for most bytes, or for a core's share if that is less."""
    size, cores = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0, texts.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // min(most, max(most >> 5, size // cores))))


def build_index(docs: DataFrame, stopwords: bool = True, queries: DataFrame | None = None) -> Index:
    """docs: (id, text). Null ids are skipped, null texts are empty; empty documents count in n and the mean length.

    Texts are read once: the postings stay in the executors' memory and disks until release(), and lost parts are computed anew.
    Texts are what is shuffled, by id: they are smaller than their postings, which then need no exchange, nor do a text's scores; a
    table of few row groups still feeds every core, and a task's share is bounded by TEXTS, whatever the session's number of shuffle partitions. With queries (qid, query) few enough to broadcast, only their terms' postings are kept.
    """
    known = docs.where(F.col("id").isNotNull())
    spread = known.select("id", "text").repartition(tasks(known, TEXTS), "id").select("id", X.tokens(F.col("text"), stopwords).alias("ts"))
    count = lambda rows: rows.groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf")).persist()
    kept = None
    if queries is not None and few(queries, F.length("query")):
        # "" is no token: a row of it a document tells how many there are and how long
        asked = query_terms(queries, stopwords).select("term").union(queries.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
        terms = spread.select("id", F.size("ts").alias("dl"), F.explode(F.concat("ts", F.array(F.lit("")))).alias("term"))
        kept = count(terms.join(F.broadcast(asked), "term", "left_semi"))
        told = kept.where("term = ''").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum(F.col("tf") * F.col("dl")), F.lit(0))).first()
        postings, n, total = kept.where("term <> ''"), told[0], told[1]
    else:
        postings = count(spread.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term")))
        n, total = known.count(), postings.agg(F.sum("tf")).first()[0] or 0
    return Index(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n, total / n if n else 1.0, kept)


def top(scored: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The n first rows of each group, with their rank."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def query_terms(queries: DataFrame, stopwords: bool = True) -> DataFrame:
    """(qid, term, qtf): a repeated token of a query counts as often."""
    return queries.select("qid", F.explode(X.tokens(F.col("query"), stopwords)).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def few(rows: DataFrame, size: Column) -> bool:
    """Whether rows are small enough to broadcast."""
    return (rows.agg(F.sum(size)).first()[0] or 0) <= SMALL_QUERIES


def bm25(queries: DataFrame, index: Index, limit: int = 10, stopwords: bool = True) -> DataFrame:
    """queries: (qid, query). Returns qid, id, score, rank. Few queries go to where the postings lie; many meet them by term."""
    small = few(queries, F.length("query"))
    q = query_terms(queries, stopwords)
    q = index.terms.join(F.broadcast(q) if small else q, "term")
    idf = F.ln(1 + (F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    q = q.select("qid", "term", (F.col("qtf") * idf).alias("w"))
    sat = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(index.avgdl or 1.0))))
    hits = index.postings.join(F.broadcast(q) if small else q, "term")
    scored = hits.groupBy("qid", "id").agg(F.sum(F.col("w") * sat).alias("score"))
    # scores are compared at nine digits, so that sums taken in another order tie alike
    return top(scored, ["qid"], limit, F.desc(F.round("score", 9)), F.asc("id")) if limit else scored


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, t: s + t)


def _similarity(a: Column, b: Column, norm: Column) -> Column:
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(a, b) / norm))).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity clamped to [0, 1]; 0 for empty, unequal or zero vectors."""
    return _similarity(a, b, F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def dense(queries: DataFrame, vectors: DataFrame, limit: int = CANDIDATES, same: list[str] | None = None) -> DataFrame:
    """queries: (qid, qv), vectors: (id, v), with the columns in same equal on both sides. Each pair of blocks keeps its best before they are merged."""
    return top(nearest(queries, vectors, limit, same or []), ["qid"], limit, F.desc(F.round("score", 9)), F.asc("id"))


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Lists of (qid, id, rank) to (qid, id, rrf): the sum of 1 / (k + rank); k of 0 or less means 60."""
    k = k if k > 0 else RRF_K
    every = lists[0].select("qid", "id", "rank")
    for more in lists[1:]:
        every = every.unionByName(more.select("qid", "id", "rank"))
    return every.groupBy("qid", "id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("rrf"))


def hybrid(sparse: DataFrame | None, found: DataFrame | None, k: int = RRF_K) -> DataFrame:
    """Fuse keyword and dense results (qid, id, score, rank) to qid, id, score, dense_score, bm25_score, rrf, rank.

    The score is the dense one where there is one, else the saturated keyword score; order is by rrf, then dense rank, keyword rank, id.
    """
    one, other = (found, sparse) if found is not None else (sparse, None)
    name = "dense" if found is not None else "bm25"
    got = one.select("qid", "id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"))
    if other is not None:
        got = got.join(other.select("qid", "id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank")), ["qid", "id"], "full")
    for c, kind in (("dense_score", "double"), ("dense_rank", "int"), ("bm25_score", "double"), ("bm25_rank", "int")):
        if c not in got.columns:
            got = got.withColumn(c, F.lit(None).cast(kind))
    part = lambda c: F.coalesce(1 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    clamp = F.when(F.col("dense_score").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("dense_score"))))
    got = got.withColumn("rrf", part("dense_rank") + part("bm25_rank")).withColumn("score", F.coalesce(clamp, X.saturation(F.col("bm25_score")), F.lit(0.0)))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("rrf", 12)), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), "id")
    return got.withColumn("rank", F.row_number().over(order)).select("qid", "id", "score", "dense_score", "bm25_score", "rrf", "rank")


def merged_subqueries(queries: DataFrame, search, limit: int = CANDIDATES) -> DataFrame:
    """Search every part of expanded queries and keep each id's best score. search: (qid, query) -> qid, id, score. A limit of 0 keeps all."""
    parts = queries.select("qid", F.posexplode(X.expand_query(F.col("query"))).alias("part", "query"))
    return best_of_parts(search(parts.select(F.struct("qid", "part").alias("qid"), "query")), limit)


def best_of_parts(found: DataFrame, limit: int = 0) -> DataFrame:
    """Results of sub-queries (qid: a struct of qid and part, id, score), each id with its best score of any part, ranked anew."""
    best = found.select(F.col("qid.qid").alias("qid"), "id", "score").groupBy("qid", "id").agg(F.max("score").alias("score"))
    order = (F.desc(F.round("score", 9)), F.asc("id"))
    return top(best, ["qid"], limit, *order) if limit else best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def search(
    queries: DataFrame, mode: str = "hybrid", *, index: Index | None = None, vectors: DataFrame | None = None, about: DataFrame | None = None, layer: str | None = None, namespace: str | None = None,
    top_k: int = 5, min_score: float | None = None, max_tokens: int | None = None, expand: bool = True, embed: Callable[[Column], Column] | None = None, scorer: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Keyword, dense or hybrid search with expansion, filters, a score floor, a reranker and a token budget.

    queries: (qid, query) and for dense and hybrid qv, the query's vector (a query may have rows with the vectors of several parts; without any, its
    dense side is empty), unless embed turns a text into one: then every part of the expanded query is embedded. Both sides keep each id's best
    score of any part. vectors: (id, v). about: (id, layer, namespace, tokens, ...), needed for filters and budgets; all its other
    columns (path, lines, section, text) come along with the results. A layer or namespace chooses vectors before they are ranked, and keyword candidates
    after. With a scorer of (query, text), hybrid results are reranked, and only those that the reranker reads stay. Returns what hybrid() does,
    rerank_score, the columns of about, ranks anew, and truncated: how many results of a query the budget left out. The budget is spent over all
    results, by rank, before the cut to top_k. A result of unknown size costs no tokens.
    """
    if mode not in ("keyword", "dense", "hybrid"):
        raise ValueError(f"no such mode: {mode}")
    again = lambda d: d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    asked = queries.select("qid", "query").distinct() if mode != "dense" or embed else None
    wanted = None
    if layer is not None or namespace is not None:
        wanted = about.where(F.lit(True) if layer is None else F.col("layer") == layer).where(F.lit(True) if namespace is None else F.col("namespace") == namespace).select("id")
    sparse = found = None
    if mode != "dense":
        sparse = merged_subqueries(asked, lambda q: bm25(q, index, CANDIDATES), 0) if expand else bm25(asked, index, CANDIDATES)
        if wanted is not None:
            sparse = again(sparse.join(wanted, "id", "left_semi"))
    if mode != "keyword":
        if embed:
            texts = F.posexplode(X.expand_query(F.col("query"))) if expand else F.posexplode(F.array("query"))
            parts = asked.select("qid", texts.alias("part", "query")).withColumn("qv", embed(F.col("query")))
        else:
            parts = queries.withColumn("part", F.xxhash64("qv"))
        parts = parts.where("qv IS NOT NULL").select(F.struct("qid", "part").alias("qid"), "qv").dropDuplicates(["qid"])
        found = best_of_parts(dense(parts, vectors if wanted is None else vectors.join(wanted, "id", "left_semi")))
    got = hybrid(sparse, found)
    if min_score is not None:
        got = again(got.where(F.col("score") >= min_score))
    got = got.withColumn("rerank_score", F.lit(None).cast("double"))
    if scorer is not None and mode == "hybrid":
        from .assess import rerank

        read = got.drop("rerank_score").join(about.select("id", "text"), "id", "left").join(queries.select("qid", "query").distinct(), "qid")
        got = rerank(read, scorer).select(got.columns)
    more = [c for c in about.columns if c not in got.columns] if about is not None else []
    if max_tokens is None:
        got = got.where(F.col("rank") <= top_k).withColumn("truncated", F.lit(0).cast("long"))
        return got.join(about.select("id", *more), "id", "left").select(*got.columns, *more) if more else got
    got = got.persist()  # read three times: what fits, and how many there were
    sized = got.join(about.select("id", "tokens"), "id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    kept = within_budget(sized, max_tokens).select(*got.columns)
    counts = got.groupBy("qid").agg(F.count(F.lit(1)).alias("all"))
    told = kept.join(counts, "qid").withColumn("truncated", F.col("all") - F.count(F.lit(1)).over(Window.partitionBy("qid"))).drop("all")
    cut = again(told).where(F.col("rank") <= top_k)
    return cut.join(about.select("id", *more), "id", "left").select(*got.columns, "truncated", *more)


def within_budget(results: DataFrame, max_tokens: int, keep_ratio: float = 0.9) -> DataFrame:
    """Greedy by rank: a result that doesn't fit is skipped and later ones may still fit; a first result too large alone is kept.

    results: (qid, rank, tokens, ...). A query's results are a top-n list, so they are folded as one array. They are read twice and kept in the session.
    """
    budget, results = int(max_tokens * keep_ratio), results.persist()
    listed = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "tokens"))).alias("rs"))

    def step(acc: Column, r: Column) -> Column:
        fits = (acc["used"] + r["tokens"] <= budget) | ((F.size(acc["kept"]) == 0) & (r["tokens"] > budget) & (r["rank"] == F.get("rs", F.lit(0))["rank"]))
        return F.when(fits, F.struct((acc["used"] + r["tokens"]).alias("used"), F.concat(acc["kept"], F.array(r["rank"])).alias("kept"))).otherwise(acc)

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    kept = listed.select("qid", F.explode(F.aggregate("rs", start, step)["kept"]).alias("rank"))
    return results.join(kept, ["qid", "rank"])


def retrieve(queries: DataFrame, search, min_score: float = 0.6, retries: int = 2) -> DataFrame:
    """One retry with a rewritten query for those whose best score stays under min_score. Both attempts run as one plan.

    search: (qid, query) -> qid, id, score, rank. Returns qid, iterations, top_score, low_confidence, id, score, rank.
    """
    attempts = 2 if min(max(retries, 0), 2) > 1 else 1
    first = search(queries).withColumn("iterations", F.lit(1))
    best = lambda d: d.groupBy("qid").agg(F.max_by("score", -F.col("rank")).alias("top_score"))
    heads = queries.select("qid", "query").join(best(first), "qid", "left").withColumn("top_score", F.coalesce("top_score", F.lit(0.0)))
    weak = heads.where(F.col("top_score") < min_score)
    if attempts == 1:
        return first.join(heads.select("qid", "top_score"), "qid").withColumn("low_confidence", F.col("top_score") < min_score)
    again = search(weak.select("qid", X.rewrite_query(F.col("query")).alias("query"))).withColumn("iterations", F.lit(2))
    both = first.join(weak.select("qid"), "qid", "left_anti").unionByName(again)
    return both.join(best(both), "qid").withColumn("low_confidence", F.col("top_score") < min_score)
