"""Counts over conversations and rankings: tokens, cost, history search, retrieval quality, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def role_tokens(messages: DataFrame, multiplier: float = 1.6) -> DataFrame:
    """Messages and token estimates of each role."""
    return messages.groupBy("role").agg(F.count(F.lit(1)).alias("n_messages"), F.sum(X.message_tokens(F.col("text"), multiplier)).alias("tokens"))


def conversation_cost(messages: DataFrame, rate_in: float, rate_out: float, multiplier: float = 1.6) -> DataFrame:
    """Input and output tokens and cost of each conversation; rates are for a million tokens. What the assistant said counts both ways."""
    t = X.message_tokens(F.col("text"), multiplier)
    out = F.when(F.col("role") == "assistant", t).otherwise(0.0)
    sums = messages.groupBy("conv_id").agg(F.sum(t).alias("tokens_in"), F.sum(out).alias("tokens_out"))
    return sums.withColumn("cost", (F.col("tokens_in") * rate_in + F.col("tokens_out") * rate_out) / 1e6)


def audit(messages: DataFrame, multiplier: float = 1.6, overhead: float = 12) -> DataFrame:
    """(conv_id, tokens_in, tokens_out), each rounded down.

    What the assistant says and what its calls hold counts both ways, condensed messages as input alone, an answer's id and name as input too.
    messages: (conv_id, role, text, condensed, call_id, name, tool_calls array<struct<id, name, arguments>>).
    """
    m = lambda c: X.message_tokens(c, multiplier)
    plain = ~F.coalesce("condensed", F.lit(False))
    said = m(F.col("text"))
    call = lambda c: m(c["id"]) + m(c["name"]) + F.length(F.coalesce(c["arguments"], F.lit(""))) / 4 * multiplier + overhead
    calls = F.when(plain, F.coalesce(F.aggregate("tool_calls", F.lit(0.0), lambda s, c: s + call(c)), F.lit(0.0))).otherwise(0.0)
    named = F.when(plain & (F.col("role") == "tool"), m(F.col("call_id")) + m(F.col("name"))).otherwise(0.0)
    out = F.when(plain & (F.col("role") == "assistant"), said).otherwise(0.0) + calls
    return messages.groupBy("conv_id").agg(F.floor(F.round(F.sum(said + named + calls), 6)).alias("tokens_in"), F.floor(F.round(F.sum(out), 6)).alias("tokens_out"))


def audit_cost(usage: DataFrame, prices: DataFrame, default: tuple[float, float, float]) -> DataFrame:
    """Costs of usage (model, tokens_in, tokens_out, tokens_missed) by a table of prices (model, rate_in, rate_out, rate_missed) for a million tokens; unlisted models pay the default."""
    rates = ("rate_in", "rate_out", "rate_missed")
    got = usage.join(prices, "model", "left")
    for name, rate in zip(rates, default, strict=True):
        got = got.withColumn(name, F.coalesce(name, F.lit(float(rate))))
    return got.withColumn("cost", (F.col("tokens_in") * F.col("rate_in") + F.col("tokens_out") * F.col("rate_out") + F.col("tokens_missed") * F.col("rate_missed")) / 1e6).drop(*rates)


def answered_calls(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """Calls (conv_id, call_id, tool) with what answered them (conv_id, call_id, text), if anything did."""
    return calls.join(answers, ["conv_id", "call_id"], "left")


def history_search(messages: DataFrame, word: str) -> DataFrame:
    """Conversations in which a user or the assistant uses a word, whole and in any case, with their number of hits."""
    hit = F.col("text").rlike(r"(?i)\b\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E\b") & F.col("role").isin("user", "assistant")
    return messages.where(hit).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_hits"), F.min("turn").alias("first_turn"))


def history_versions(messages: DataFrame, word: str, titles: DataFrame) -> DataFrame:
    """(title, versions, matching, latest): conversations by title (conv_id, title) in which any version uses a word; a page of them is ordered by latest.

    The word is looked for in each conversation once; what is grouped afterwards is a row a conversation.
    """
    hits = history_search(messages, word).select("conv_id", F.lit(1).alias("hit"))
    told = titles.select("conv_id", F.lower(F.trim("title")).alias("title")).join(hits, "conv_id", "left")
    return told.groupBy("title").agg(F.count(F.lit(1)).alias("versions"), F.count("hit").alias("matching"), F.max("conv_id").alias("latest")).where("matching > 0")


def retrieval_metrics(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """ranked: (qid, rank, relevant, score); queries without results count as misses."""
    best = ranked.groupBy("qid").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.sum((F.col("relevant") & (F.col("rank") <= 3)).cast("int")).alias("good3"), F.max_by("score", -F.col("rank")).alias("top"))
    all_ = queries.select("qid").join(best, "qid", "left")
    at = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    return all_.agg(F.count(F.lit(1)).alias("n"), at(1).alias("hit1"), at(3).alias("hit3"), F.avg(F.coalesce(F.col("good3"), F.lit(0)) / 3.0).alias("p3"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce("top", F.lit(0.0))).alias("avg_top_score"))


def token_savings(results: DataFrame, sources: DataFrame, overhead: int = 60) -> DataFrame:
    """(qid, tokens_with, tokens_without, savings): what a query's results (qid, tokens) and the framing of a call cost against its whole sources (qid, tokens), in percent."""
    cost = results.groupBy("qid").agg(F.sum("tokens").alias("t"))
    whole = sources.groupBy("qid").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_without"))
    got = whole.join(cost, "qid", "left").withColumn("tokens_with", F.coalesce("t", F.lit(0)) + overhead)
    saved = F.when(F.col("tokens_without") > 0, (1 - F.col("tokens_with") / F.col("tokens_without")) * 100).otherwise(0.0)
    return got.select("qid", "tokens_with", "tokens_without", saved.alias("savings"))


def confidence(found: DataFrame, queries: DataFrame, min_score: float = 0.6) -> DataFrame:
    """One row: how many queries there are, the share whose best result stays under min_score, and mean tokens of their results (qid, score, tokens)."""
    each = queries.select("qid").join(found.groupBy("qid").agg(F.max("score").alias("best"), F.sum("tokens").alias("t")), "qid", "left")
    return each.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.coalesce("best", F.lit(0.0)) < min_score, 1.0).otherwise(0.0)).alias("low_confidence"), F.avg(F.coalesce("t", F.lit(0))).alias("mean_tokens"))


def plain_answers(results: DataFrame, expected: DataFrame, longest: int = 500) -> DataFrame:
    """(qid, id, answer): the first of a query's results (qid, id, rank, file_path, text) from its expected source (qid, source), or else its first, as an excerpt; null without results."""
    told = results.join(expected, "qid").withColumn("other", ~F.coalesce(F.contains(F.coalesce("file_path", F.lit("")), F.col("source")), F.lit(False)))
    best = told.groupBy("qid").agg(F.min_by(F.struct("id", "text"), F.struct("other", "rank")).alias("b"))
    text = F.coalesce("b.text", F.lit(""))
    cut = F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text)
    return expected.select("qid").join(best.select("qid", F.col("b.id").alias("id"), cut.alias("answer")), "qid", "left")


def nearest_rank(values: DataFrame, by: str, column: str) -> DataFrame:
    """Count, extremes, mean and nearest-rank percentiles of each group."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")
    return values.groupBy(by).agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.avg(column).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def latest_versions(messages: DataFrame) -> DataFrame:
    """Conversations grouped by their first user message, lower-cased and trimmed: versions, and the latest id."""
    first = messages.where(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"))
    return first.groupBy(F.lower(F.trim("title")).alias("title")).agg(F.count(F.lit(1)).alias("versions"), F.max("conv_id").alias("latest"))


def gaps_and_islands(rows: DataFrame, by: str, order: str, start) -> DataFrame:
    """rows with a column island that counts the rows flagged by start up to each."""
    return rows.withColumn("island", F.sum(start.cast("int")).over(Window.partitionBy(by).orderBy(order)))


def tool_usage(messages: DataFrame, rate_in: float, rate_out: float, multiplier: float = 1.6, overhead: float = 12) -> DataFrame:
    """Calls, tokens and cost of each tool: what calls say counts as output, what tools answer as input; rates are for a million tokens.

    messages: (role, name, text, tool_calls array<struct<id, name, arguments>>). Calls and answers without a name are left out.
    """
    said = messages.where(F.col("role") == "assistant").select(F.explode("tool_calls").alias("c"))
    # ids and names count by words, arguments by characters
    spoken = X.message_tokens(F.col("c.id"), multiplier) + X.message_tokens(F.col("c.name"), multiplier) + F.length(F.coalesce("c.arguments", F.lit(""))) / 4 * multiplier + overhead
    calls = said.select(F.col("c.name").alias("tool"), F.lit(1).alias("call"), F.lit(0.0).alias("i"), spoken.alias("o"))
    answers = messages.where(F.col("role") == "tool").select(F.col("name").alias("tool"), F.lit(0).alias("call"), X.message_tokens(F.col("text"), multiplier).alias("i"), F.lit(0.0).alias("o"))
    # one aggregate over both sides instead of a full join of two
    sums = calls.unionByName(answers).where("tool IS NOT NULL AND tool <> ''").groupBy("tool").agg(F.sum("call").alias("calls"), F.round(F.sum("i")).cast("long").alias("tokens_in"), F.round(F.sum("o")).cast("long").alias("tokens_out"))
    return sums.withColumn("cost", (F.col("tokens_in") * rate_in + F.col("tokens_out") * rate_out) / 1e6)


def audit_turns(usage: DataFrame, prices: DataFrame, default: tuple[float, float, float]) -> DataFrame:
    """(level, conv_id, turn, tokens_in, tokens_out, sub_agents, cost, running_in, running_out): a row a turn, a conversation and one for all.

    usage: (conv_id, turn, agent, model, tokens_in, tokens_out, last_in), agent null for the conversation's own model; prices as in audit_cost. The
    conversation's model pays for what it read and wrote, and last_in again as unknown to its cache. A sub-agent pays that rate for its last
    call's last_in alone, and the plain one for what it had read before, tokens_in - last_in, if that isn't negative. Running sums are those of a
    conversation's turns; levels above have their own sums there. conv_id and turn are null in the levels that sum over them.
    """
    rates = dict(zip(("rate_in", "rate_out", "rate_missed"), default, strict=True))
    priced = usage.join(prices, "model", "left").withColumns({k: F.coalesce(k, F.lit(float(v))) for k, v in rates.items()})
    paid = F.when(F.col("agent").isNull(), F.col("tokens_in")).otherwise(F.greatest(F.lit(0), F.col("tokens_in") - F.col("last_in")))
    cost = (paid * F.col("rate_in") + F.col("tokens_out") * F.col("rate_out") + F.col("last_in") * F.col("rate_missed")) / 1e6
    sums = priced.withColumn("cost", cost).rollup("conv_id", "turn").agg(
        F.grouping_id().alias("g"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count("agent").alias("sub_agents"), F.sum("cost").alias("cost")
    )
    upto = Window.partitionBy("g", "conv_id").orderBy("turn")
    level = F.when(F.col("g") == 0, "turn").when(F.col("g") == 1, "conversation").otherwise("total")
    return sums.select(level.alias("level"), "conv_id", "turn", "tokens_in", "tokens_out", "sub_agents", "cost", F.sum("tokens_in").over(upto).alias("running_in"), F.sum("tokens_out").over(upto).alias("running_out"))
