"""Nested settings merged as rows of paths: defaults, then any number of patches, the last word on each path wins.

Objects merge key by key. A value that is no object replaces what stood at its path, an object's whole inside too; an object replaces a value that is none; an
empty object leaves an object as it is. Null is a value. Objects deeper than DEPTH are values as a whole.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 8
# Settings that hold where nothing else is said.
DEFAULTS = {
    "thresholds": {"min_score": 0.6, "max_retries": 2},
    "hybrid": {"top_n_candidates": 50, "rrf_k": 60},
    "reranker": {"enabled": True, "top_n": 10},
    "tokenizer": {"safety_buffer_ratio": 0.1},
    "watcher": {"debounce_ms": 700, "active_layers": ["knowledge"]},
}


def flattened(rows: DataFrame) -> DataFrame:
    """rows (id, place, json) as (id, place, path array<string>, value variant, hollow): a row a leaf, hollow where it is an empty object. Text that is no JSON object says nothing."""
    spark = rows.sparkSession
    whole = rows.select("id", "place", F.array().cast("array<string>").alias("path"), F.try_parse_json("json").alias("value"))
    told = whole.where(F.startswith(F.schema_of_variant("value"), F.lit("OBJECT<")))
    for _ in range(DEPTH):
        # an object gives way to what it holds; all else stays as it is
        kind = F.schema_of_variant("value")
        held = told.withColumn("held", F.when(F.startswith(kind, F.lit("OBJECT<")) & (kind != "OBJECT<>"), F.col("value")))
        told = spark.sql("SELECT id, place, IF(held IS NULL, path, array_append(path, e.key)) AS path, IF(held IS NULL, own, e.value) AS value FROM {rows}, LATERAL variant_explode_outer(held) AS e", rows=held.withColumnRenamed("value", "own"))
    return told.where(F.size("path") > 0).withColumn("hollow", F.schema_of_variant("value") == "OBJECT<>")


def _key(path: Column) -> Column:
    """A path as one text that no other path has."""
    return F.to_json(path)


def merged(leaves: DataFrame) -> DataFrame:
    """(id, path, value) that stand after all places of flattened() rows; value as JSON text. Everything meets by (id, path), so ids spread over tasks."""
    own = leaves.withColumn("key", _key(F.col("path")))
    heads = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))
    said = own.groupBy("id", "key").agg(F.max("place").alias("last"), F.max(F.when(~F.col("hollow"), F.col("place"))).alias("last_full"))
    # what a leaf is ended by: a later value at its path or above, or a later leaf below it
    above = own.select("id", "key", "place", F.explode(F.transform(heads, _key)).alias("head")).join(said.withColumnRenamed("key", "head"), ["id", "head"])
    ended = F.when(F.col("head") == F.col("key"), F.col("last")).otherwise(F.col("last_full")) > F.col("place")
    ends_above = above.where(ended).select("id", "key", "place").distinct()
    below = own.where(F.size("path") > 1).select("id", "place", F.explode(F.transform(F.filter(heads, lambda h: F.size(h) < F.size("path")), _key)).alias("key")).groupBy("id", "key").agg(F.max("place").alias("below"))
    left = own.join(ends_above, ["id", "key", "place"], "left_anti").join(below, ["id", "key"], "left").where(F.col("below").isNull() | (F.col("below") <= F.col("place")))
    # an empty object isn't a leaf where something inside it stands
    inside = left.where(F.size("path") > 1).select("id", F.explode(F.transform(F.filter(heads, lambda h: F.size(h) < F.size("path")), _key)).alias("key")).distinct()
    whole = left.join(inside.withColumn("inner", F.lit(True)), ["id", "key"], "left").where(~(F.col("hollow") & F.coalesce("inner", F.lit(False))))
    return whole.select("id", F.array_join("path", ".").alias("path"), F.to_json("value").alias("value"))


def settings(patches: DataFrame, defaults: dict | None = None) -> DataFrame:
    """(id, path, value) of every id of patches (id, place from 1, json), over the defaults."""
    base = json.dumps(DEFAULTS if defaults is None else defaults)
    first = patches.select("id").distinct().select("id", F.lit(0).cast("long").alias("place"), F.lit(base).alias("json"))
    return merged(flattened(first.unionByName(patches.select("id", F.col("place").cast("long").alias("place"), "json"))))
