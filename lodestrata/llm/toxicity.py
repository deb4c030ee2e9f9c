"""Toxicity by weak supervision.

Voters for both classes vote on a bounded sample of labelled rows: a fixed lexicon and patterns of address and shouting for class 1, patterns of
courtesy and reference for class 0 (no label is read for any of these), and all patterns mined from labels that are pure enough: words, stems, and
families, that is stems that two, three or more distinct words of a text share. A generative label model estimates by expectation
maximisation, without looking at labels, how often each voter fires in each class and which voters are correlated; correlated voters speak once. A
linear classifier over hashed words, stems and families is trained on the posterior labels. Training reads all features of at most TRAIN_ROWS rows, fewer
if their features come to over quality.TRAIN_FEATURES. Scoring reads every whole text.

Defined cases: null ids or labels train nothing; of rows that repeat an id one text trains; an empty text scores the intercept; without labelled
rows every score is 0.5; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop, fold, keep, trim
from .linear import _TOKEN, FAMILIES, STEMS, WIDTH, Ftrl, Hasher, presence_features, sigmoid
from .quality import FOLDS, gathered, training_rows

TRAIN_ROWS = 8000
THRESHOLD = 0.5
LEAST, PURE = 5, 20  # rows of class 1 that a mined pattern stands in, and so many times those of class 0
EPOCHS = 3
CORRELATED = 0.3  # residual correlation from which voters are one group

# Insults that vote toxic wherever they stand.
LEXICON = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "disgusting", "worthless", "clown", "dumb", "imbecile", "vermin", "filth")
# Patterns of whole texts that vote for class 1 and for class 0.
HOSTILE = (rf"(?i)\b(?:you|they|he|she)(?:'re| are| is)? (?:an? |such |all )?(?:{'|'.join(LEXICON)})", r"(?i)\b(?:shut up|get lost|go away|hate you|hate them)\b", r"(?:\b[A-Z]{3,}\b[ ,]*){4,}[!?]", r"!{3,}")
CALM = (r"(?i)\b(?:please|thanks|thank you|kind regards|sincerely|welcome)\b", r"(?i)\b(?:licen[sc]e|copyright|permission|warranty)\b", r"https?://", r"(?m)^#{1,6} ", r"\b[0-9]{4}\b")


def terms_of(text: str | None) -> set[str]:
    """Lower-cased words, and stems with how many distinct words they begin: idio~1, idio~2."""
    tokens = set(_TOKEN.findall((text or "").lower()))
    families = Counter(t[:k] for t in tokens for k in STEMS if len(t) > k)
    return tokens | {f"{s}~{n}" for s, c in families.items() for n in (1, *FAMILIES) if c >= n}


def mine_patterns(rows: DataFrame) -> list[str]:
    """The terms that speak for label 1 in training rows (doc_id, y, text), all that are pure and frequent enough: a table bounded by the training rows'."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for t in terms_of(text):
                    seen.setdefault(t, [0, 0])[y > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], names=["term", "n0", "n1"])

    totals = (
        rows.select("y", "text").mapInArrow(emit, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where((F.col("n1") >= LEAST) & (F.col("n1") >= PURE * F.col("n0"))).orderBy(F.desc("n1"), "term")
    )
    return [r.term for r in totals.collect()]


def label_model(votes: np.ndarray, calm: int = 0, rounds: int = 30) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row of a 0/1 vote matrix, and what the model estimated. The last calm voters speak for class 0.

    A voter that doesn't fire abstains; a row on which no voter for class 1 fires has the one vote of silence for class 0. Voters are conditionally
    independent but for groups whose residuals correlate (chains of such pairs are one group): a group speaks once in a row, by its strongest
    voter that fires, so that copies of a voter don't vote twice.
    """
    n, m = votes.shape
    hits = votes[:, : m - calm].sum(1)
    if not n or not hits.any():
        return np.zeros(n), {"accuracy": np.full(m, 0.5), "correlation": np.eye(m)}
    post = np.where(hits > 0, 0.9, 0.02)
    silent = hits == 0
    group, correlation = np.arange(m), np.eye(m)
    for step in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        on = np.clip((votes.T @ post + 0.5) / (post.sum() + 1), 1e-4, 1 - 1e-4)
        off = np.clip((votes.T @ (1 - post) + 0.01) / ((1 - post).sum() + 1), 1e-5, 1 - 1e-4)
        if step == 3:  # rates have settled enough to tell what they leave unexplained
            residual = votes - (post[:, None] * on + (1 - post)[:, None] * off)
            scale = np.sqrt(np.maximum((residual**2).mean(0), 1e-9))
            correlation = (residual.T @ residual) / n / np.outer(scale, scale)
            for j in range(m):
                for k in np.flatnonzero(correlation[j, :j] > CORRELATED):
                    group[group == group[j]] = group[k]
        quiet = np.log(((silent * post).sum() + 0.5) / (post.sum() + 1)) - np.log(((silent * (1 - post)).sum() + 0.5) / ((1 - post).sum() + 1))
        said = votes * np.log(on / off)
        odds = np.log(prior / (1 - prior)) + silent * quiet
        for g in np.unique(group):
            high, low = said[:, group == g].max(1), said[:, group == g].min(1)
            odds += np.where(high >= -low, high, low)
        post = 1 / (1 + np.exp(-np.clip(odds, -35, 35)))
        # the intended class is the one that voters speak for
        if (post * hits).sum() / max(post.sum(), 1e-9) < ((1 - post) * hits).sum() / max((1 - post).sum(), 1e-9):
            post = 1 - post
    return post, {"accuracy": prior * on + (1 - prior) * (1 - off), "correlation": correlation, "group": group}


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights of WIDTH slots and the intercept, from posterior labels of at most TRAIN_ROWS rows."""
    rows = keep(training_rows(docs, labels, "toxic", TRAIN_ROWS), "rows")
    voters = list(dict.fromkeys([*LEXICON, *(f"{w[:6]}~1" for w in LEXICON if len(w) > 6), *mine_patterns(rows)]))
    m = len(voters) + len(HOSTILE) + len(CALM)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        patterns = [re.compile(p) for p in (*HOSTILE, *CALM)]
        for batch in batches:
            slots, votes = [], []
            for text in batch.column("text").to_pylist():
                own = terms_of(text)
                said = [v in own for v in voters] + [p.search(text or "") is not None for p in patterns]
                votes.append(np.array(said, np.uint8).tobytes())
                slots.append(presence_features(text, hasher).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(votes, pa.binary()), pa.array(slots, pa.binary())], names=["doc_id", "votes", "slots"])

    got = gathered(rows.mapInArrow(featurise, "doc_id long, votes binary, slots binary"))
    drop(rows)
    got = got.iloc[np.lexsort((got.slots.map(len), got.doc_id, (got.doc_id.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)))]
    model = Ftrl(alpha=1.0, l1=2.0, l2=0.001)
    if len(got):
        posterior, _ = label_model(np.frombuffer(b"".join(got.votes), np.uint8).reshape(len(got), m).astype(float), len(CALM))
        rows_slots = [np.frombuffer(s, np.int32) for s in got.slots]
        for _ in range(EPOCHS):
            for u, p in zip(rows_slots, posterior, strict=True):
                model.update(u, np.ones(len(u)), float(p))
    return model.weights()


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. No shuffle of texts but the training rows' join."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # WIDTH + 1 floats, whatever the input
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hasher = shared.value, Hasher()
        for batch in batches:
            scores = [sigmoid(float(w[WIDTH]) + float(w[presence_features(t.as_py(), hasher)].sum(dtype=float))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])
        del hasher
        trim()

    return plain.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
