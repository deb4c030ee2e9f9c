"""Files of several layers, each under its own root with its own ignore rules, and lists of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus
from . import files

# Fixed value: the name of a root's file of ignore rules.
RULES = ".ragignore"


def ignore_rules(spark: SparkSession, root: str, name: str = RULES) -> list[str]:
    """The rules in a root's ignore file, without comments and blank lines; none without the file."""
    if name not in files.names(spark, root):
        return []
    lines = (line.strip() for line in files.read_text(spark, f"{root.rstrip('/')}/{name}").splitlines())
    return [line for line in lines if line and not line.startswith("#")]


def layer_files(spark: SparkSession, roots: dict[str, str], content: bool = True) -> DataFrame:
    """(layer, path, namespace, name, length, modified[, content, file_hash]) of the indexed files below each layer's root; path is relative to it.

    Without content no file is opened: the names and sizes alone are listed.
    """
    found = None
    for layer, root in roots.items():
        held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        base = files.qualified(spark, root)
        rows = held.select(F.lit(layer).alias("layer"), X.relative_path(F.col("path"), base).alias("path"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
        rows = rows.where(corpus.indexable(F.col("path"), ignore_rules(spark, root)) & (X.base_name(F.col("path")) != RULES))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no layers")
    named = found.withColumns({"namespace": F.regexp_extract("path", r"^(?s)(.*)/[^/]*$", 1), "name": X.base_name(F.col("path"))})
    if content:
        named = named.withColumn("file_hash", F.sha2("content", 256))
    return named.select("layer", "path", "namespace", "name", "length", "modified", *(["content", "file_hash"] if content else []))


def resolve_inputs(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """(place, path) of the supported files that a list of files, folders and patterns names: each once, in the order of the list, then by path."""
    found = None
    for i, one in enumerate(inputs):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(one).select(F.lit(i).alias("input"), "path")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "place long, path string")
    known = found.where(X.extension(F.col("path")).isin(*corpus.EXTENSIONS)).groupBy("path").agg(F.min("input").alias("input"))
    return known.orderBy("input", "path").select(F.monotonically_increasing_id().alias("place"), "path")
