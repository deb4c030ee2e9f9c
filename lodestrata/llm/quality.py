"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Training reads at most TRAIN_ROWS labelled rows (those with the smallest hash of their id), fewer if their
features come to over TRAIN_FEATURES, and all features of each; scoring reads every whole text. Weights have
a fixed size, so they are broadcast.

Defined cases: null ids, labels or texts train nothing; of rows that repeat an id one text trains, the one with the smallest hash; an empty text scores the intercept; without
labels every score is 0.5; repeated rows each get their row; other columns pass through score_rows().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import drop, fold, keep, trim
from .linear import WIDTH, Ftrl, Hasher, counted, ngram_features, sigmoid

TRAIN_ROWS = 8000
TRAIN_FEATURES = 20_000_000  # of all training rows together
EPOCHS = 3
THRESHOLD = 0.3
FOLDS = 5


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int = TRAIN_ROWS) -> DataFrame:
    """At most limit labelled rows outside the held-out fold, one an id: doc_id, y, text. An id labelled both ways counts as 0."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
        .groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    met = texts.join(F.broadcast(chosen), "doc_id")  # at most limit rows of 16 bytes
    # copies of an id meet before the shuffle, so that at most limit texts go on
    return met.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        slots, values = [], []
        for text in batch.column("text"):
            u, v = counted(ngram_features(text.as_py(), hasher))
            slots.append(u.astype(np.int32).tobytes())
            values.append(v.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "y", "slots", "vals"])
    del hasher
    trim()


def gathered(rows: DataFrame) -> pd.DataFrame:
    """Featurised rows (doc_id, slots, ...) on the driver: whole ones, by the hash of their ids as far as TRAIN_FEATURES reaches, the first in any case."""
    kept = keep(rows, "training")
    sizes = kept.select(F.xxhash64("doc_id").alias("h"), (F.octet_length("slots") / 4).alias("n")).toPandas().sort_values("h")
    over = sizes.h[(sizes.n.cumsum() > TRAIN_FEATURES) & (sizes.h > sizes.h.min())]
    got = (kept.where(F.xxhash64("doc_id") < F.lit(int(over.iloc[0]))) if len(over) else kept).toPandas()
    drop(kept)
    return got


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray:
    """Weights of WIDTH slots and the intercept."""
    rows = gathered(training_rows(docs, labels, label).mapInArrow(_featurise, "doc_id long, y double, slots binary, vals binary"))
    order = np.lexsort((rows.slots.map(len), rows.doc_id, (rows.doc_id.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)))
    model = Ftrl(alpha=0.3, l2=0.3)
    for _ in range(EPOCHS):
        for slots, vals, y in zip(rows.slots[order], rows.vals[order], rows.y[order], strict=True):
            model.update(np.frombuffer(slots, np.int32), np.frombuffer(vals, np.float32), float(y > 0))
    weights = model.weights()
    del rows, model
    trim()
    return weights


def score_rows(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """docs with a column more, the probability of label 1. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # WIDTH + 1 floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hasher = shared.value, Hasher()
        for batch in batches:
            scores = []
            for text in batch.column("text"):
                f = ngram_features(text.as_py(), hasher)
                scores.append(sigmoid(float(w[WIDTH]) + (float(w[f].sum(dtype=float)) / np.sqrt(len(f)) if len(f) else 0.0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, column])
        del hasher
        trim()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    weights = train(docs, labels)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score_rows(plain, weights).select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
