"""What follows a retrieval: reranking by a scorer, grouping of paragraphs by meaning, scoring of evaluation scenarios."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import measure, search

RERANKED = 10
SIMILAR = 0.35  # consecutive paragraphs below are of different groups
CONFIDENT = 0.60


def rerank(results: DataFrame, scorer: Callable[[Column, Column], Column] | None, top_n: int = RERANKED) -> DataFrame:
    """results (qid, query, rank, id, text, ...) with rerank_score; the best top_n (ten at most) only, best first.

    Without a scorer results stay as they are, with null scores. A null score comes last; ties keep their rank.
    """
    if scorer is None:
        return results.withColumn("rerank_score", F.lit(None).cast("double"))
    scored = results.where(F.col("rank") <= min(top_n, RERANKED)).withColumn("rerank_score", scorer(F.col("query"), F.coalesce("text", F.lit(""))).cast("double"))
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return scored.withColumn("__place", F.row_number().over(order)).drop("rank").withColumnRenamed("__place", "rank")


def semantic_groups(paragraphs: DataFrame) -> DataFrame:
    """paragraphs (id, pos, text, vector) joined while consecutive ones are alike: (id, part, text).

    Fewer than three paragraphs, or one without a vector, leave a text's paragraphs as they are.
    """
    own = Window.partitionBy("id")
    before = F.lag("vector").over(own.orderBy("pos"))
    whole = (F.count(F.lit(1)).over(own) >= 3) & (F.min(F.coalesce(F.size("vector"), F.lit(0))).over(own) > 0)
    cut = F.when(F.col("__whole"), before.isNotNull() & (search.cosine(F.col("vector"), F.col("__before")) < SIMILAR)).otherwise(F.lit(True))
    rows = paragraphs.withColumns({"__before": before, "__whole": whole}).withColumn("__cut", cut)
    parts = measure.gaps_and_islands(rows, "id", "pos", F.col("__cut"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"])
    joined = parts.groupBy("id", F.col("island").alias("part")).agg(F.trim(F.array_join(texts, "\n\n")).alias("text"))
    return joined.where("text <> ''")


def extraction_density(docs: DataFrame) -> DataFrame:
    """Characters, lines and the share of blank lines of each extracted text; ok if it has any."""
    t = F.coalesce("text", F.lit(""))
    lines = F.split(t, "\n", -1)
    blank = F.size(F.filter(lines, lambda s: F.length(F.trim(F.regexp_replace(s, r"(?U)\s", ""))) == 0))
    return docs.select("id", F.length(t).alias("n_chars"), F.size(lines).alias("n_lines"), F.round(blank / F.size(lines), 2).alias("blank_density"), (F.length(t) > 0).alias("ok"))


def _step(ratio: Column, *steps: float) -> Column:
    """5 from the first of four falling steps on, then 4, 3, 2; 1 below all."""
    out = F.lit(1)
    for score, least in zip((2, 3, 4, 5), reversed(steps), strict=True):
        out = F.when(ratio >= least, score).otherwise(out)
    return out


def scenario_scores(scenarios: DataFrame, results: DataFrame) -> DataFrame:
    """Relevance and grounding, 1 to 5, of what each scenario's query found, and a verdict on those out of scope.

    scenarios: (qid, expected_markers array<string>, expected_source, ground_truth, out_of_scope); results: (qid, rank, file_path, text, score), few a query.
    """
    found = results.groupBy("qid").agg(
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text")))), lambda r: r["text"]), " ")).alias("context"),
        F.collect_set(F.coalesce("file_path", F.lit(""))).alias("paths"), F.min_by("score", "rank").alias("top"),
    )
    rows = scenarios.join(found, "qid", "left").withColumn("context", F.coalesce("context", F.lit("")))
    ratio = lambda words: F.size(F.filter(words, lambda w: F.contains(F.col("context"), F.lower(w)))) / F.greatest(F.size(words), F.lit(1))
    markers = F.coalesce("expected_markers", F.array().cast("array<string>"))
    truth = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("ground_truth", F.lit(""))), r"(?U)\s+"), lambda w: F.length(w) > 4))
    source = F.coalesce(F.exists("paths", lambda p: F.contains(p, F.col("expected_source"))), F.coalesce("expected_source", F.lit("")) == "")
    hit = ratio(markers)
    relevance = F.when((hit >= 0.75) & source, 5).when((hit >= 0.5) & source, 4).when((hit >= 0.25) | source, 3).when(hit > 0, 2).otherwise(1)
    outside = F.when(F.col("top").isNull(), 5).when(F.col("top") < CONFIDENT, 4).otherwise(2)
    grounded = F.when(F.coalesce("ground_truth", F.lit("")) == "", 3).otherwise(_step(ratio(truth), 0.8, 0.6, 0.4, 0.2))
    return rows.select(
        "qid", F.when(F.col("out_of_scope"), outside).when(F.size(markers) == 0, 3).otherwise(relevance).alias("context_relevance"),
        F.when(~F.col("out_of_scope"), grounded).alias("faithfulness"),
        F.when(~F.col("out_of_scope"), "NA").when(F.coalesce(F.col("top"), F.lit(0.0)) < CONFIDENT, "PASS").otherwise("WARN").alias("hallucination"),
    )


def language_profiles(texts: DataFrame) -> DataFrame:
    """(lang, letter, weight): log frequencies of letters in texts (lang, text) of each language, those that it lacks left out; a table of languages times letters."""
    letter = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}"), F.lit(0)))
    counts = texts.where(F.col("lang").isNotNull()).select("lang", letter.alias("letter")).groupBy("lang", "letter").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    return counts.select("lang", "letter", F.ln(F.col("n") / total).alias("weight"))


def identify_language(texts: DataFrame, profiles: DataFrame, unseen: float = -14.0) -> DataFrame:
    """(id, lang) of texts (id, text): the language under whose letter frequencies a text is likeliest; ties to the first by name, null without letters.

    Letters are counted within each text's row; what is joined is a row a text and letter, and the profiles, which languages and alphabets bound, are broadcast.
    """
    letters = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}"), F.lit(0))
    counted = texts.select("id", F.explode_outer(letters).alias("letter")).groupBy("id", "letter").agg(F.count(F.lit(1)).alias("n"))
    table = profiles.groupBy("letter").agg(F.map_from_entries(F.collect_list(F.struct("lang", "weight"))).alias("weights"))
    names = F.broadcast(profiles.agg(F.array_sort(F.collect_set("lang")).alias("langs")).withColumn("one", F.lit(1)))
    met = counted.join(F.broadcast(table), "letter", "left").withColumn("one", F.lit(1)).join(names, "one")
    score = F.explode(F.transform("langs", lambda l: F.struct(l.alias("lang"), (F.col("n") * F.coalesce(F.try_element_at("weights", l), F.lit(unseen))).alias("s"))))
    sums = met.select("id", "letter", score.alias("s")).groupBy("id", "s.lang").agg(F.sum("s.s").alias("s"), F.max(F.col("letter").isNotNull()).alias("any"))
    # likelihoods are compared at six digits, so that sums taken in another order tie alike
    return sums.groupBy("id").agg(F.min(F.when(F.col("any"), F.struct((-F.round("s", 6)).alias("s"), "lang"))).alias("b")).select("id", "b.lang")


def rubric(scenarios: DataFrame, results: DataFrame, answers: DataFrame, languages: DataFrame) -> DataFrame:
    """All five scores of each scenario: scenario_scores, and from 1 to 5 how far its answer meets the question and how natural its language is.

    scenarios: as in scenario_scores, with query and language (null: any); answers: (qid, answer), an out-of-scope one null where the system declined;
    languages: (qid, lang), that of the context. An answer meets the question by the share of the query's words over three letters that it
    holds, and by a marker; its language is judged by the context's and by the markers that context or answer keep as they are.
    """
    context = results.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text")))), lambda r: r["text"]), " ").alias("context"))
    rows = scenarios.join(context, "qid", "left").join(answers.select("qid", "answer"), "qid", "left").join(languages.select("qid", F.col("lang").alias("found")), "qid", "left")
    rows = rows.withColumns({"context": F.coalesce("context", F.lit("")), "said": F.coalesce("answer", F.lit("")), "markers": F.coalesce("expected_markers", F.array().cast("array<string>"))})
    words = F.filter(F.split(F.lower(F.coalesce("query", F.lit(""))), r"(?U)\s+"), lambda w: F.length(w) > 3)
    met = F.size(F.filter(words, lambda w: F.contains(F.lower("said"), w))) / F.greatest(F.size(words), F.lit(1))
    marked = F.exists("markers", lambda m: F.contains(F.lower("said"), F.lower(m)))
    relevance = F.when((met >= 0.6) & marked, 5).when((met >= 0.4) & marked, 4).when((met >= 0.3) | marked, 3).when(met > 0, 2).otherwise(1)
    kept = F.exists("markers", lambda m: F.contains(F.col("context"), m) | F.contains(F.col("said"), m))
    own = F.col("found") == F.col("language")
    any_ = F.col("found").isNotNull()
    within = F.when(F.coalesce(own, F.lit(False)), F.when(kept, 5).otherwise(4)).when(any_ & kept & (F.col("language") != "en"), 3).otherwise(2)
    across = F.when(any_ & kept, 5).when(any_, 3).otherwise(1)
    told = rows.select(
        "qid", "out_of_scope", F.when(F.col("out_of_scope"), F.when(F.col("answer").isNull(), 5).otherwise(1)).otherwise(relevance).alias("answer_relevance"),
        F.when(F.col("out_of_scope"), 4).when(F.col("language").isNull(), across).otherwise(within).alias("language_naturalness"),
    )
    return scenario_scores(scenarios, results).join(told, "qid")


# Least averages, and the share of out-of-scope scenarios that must be handled.
LEAST_RELEVANCE, LEAST_FAITH, LEAST_ANSWER, LEAST_HANDLED = 3.5, 3.5, 3.0, 0.67


def rubric_gate(scores: DataFrame) -> DataFrame:
    """One row over rubric(): averages, how many out-of-scope scenarios there are and were handled (passed or warned), and whether all is good enough; averages over nothing are 0."""
    inside = ~F.col("out_of_scope")
    mean = lambda c, where=F.lit(True): F.coalesce(F.avg(F.when(where, F.col(c))), F.lit(0.0))
    one = scores.agg(
        F.count(F.lit(1)).alias("n"), mean("context_relevance").alias("context_relevance"), mean("faithfulness", inside).alias("faithfulness"), mean("answer_relevance").alias("answer_relevance"),
        mean("language_naturalness", inside).alias("language_naturalness"), F.count_if("out_of_scope").alias("outside"), F.count_if(F.col("out_of_scope") & F.col("hallucination").isin("PASS", "WARN")).alias("handled"),
    )
    overall = (F.col("context_relevance") + F.col("faithfulness") + F.col("answer_relevance") + F.col("language_naturalness")) / 4
    good = (F.col("context_relevance") >= LEAST_RELEVANCE) & (F.col("faithfulness") >= LEAST_FAITH) & (F.col("answer_relevance") >= LEAST_ANSWER) & (F.col("handled") >= LEAST_HANDLED * F.col("outside"))
    return one.withColumn("overall", overall).withColumn("passed", good)
