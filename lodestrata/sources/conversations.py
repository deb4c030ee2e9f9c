"""Saved conversations: JSON files by day, read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS = "array<struct<id: string, type: string, function: struct<name: string, arguments: string>>>"
MESSAGE = f"role: string, content: string, reasoning_content: string, name: string, tool_call_id: string, tool_calls: {CALLS}, condensed: boolean"
SCHEMA = f"title string, saved_at timestamp, model_name string, message_count int, messages array<struct<{MESSAGE}>>, damaged_text string"


def save_conversations(conversations: DataFrame, root: str, mode: str = "append") -> None:
    """Write (title, saved_at, model_name, messages array<struct<role, content, ...>>) as JSON lines in a folder a day; what a model reasoned isn't kept."""
    fields = [f.name for f in conversations.schema["messages"].dataType.elementType.fields if f.name != "reasoning_content"]
    lean = F.transform("messages", lambda m: F.struct(*(m[f].alias(f) for f in fields)))
    rows = conversations.select("title", "saved_at", "model_name", F.coalesce(F.size("messages"), F.lit(0)).alias("message_count"), lean.alias("messages"), F.date_format("saved_at", "yyyy-MM-dd").alias("day"))
    # a day's conversations meet before they are written, spread over some tasks, so that a day has few files
    rows.repartition("day", F.pmod(F.xxhash64("title"), F.lit(8))).write.mode(mode).partitionBy("day").json(root)


def _lean(messages: Column) -> Column:
    return F.transform(messages, lambda m: m.dropFields("reasoning_content"))


def read_conversations(spark: SparkSession, root: str, multi_line: bool = False) -> DataFrame:
    """(day, title, saved_at, model_name, message_count, messages, damaged): damaged rows have what could be read, and count no messages without any.

    multi_line reads files that hold one indented conversation each. Audit files, with (AUDIT) in their name, are left out.
    """
    rows = (
        spark.read.schema(f"{SCHEMA}, day string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "damaged_text").option("multiLine", multi_line)
        .option("recursiveFileLookup", multi_line).json(root)
    )
    rows = rows.where(~F.contains(F.col("_metadata.file_name"), F.lit("(AUDIT)")) & ~F.contains(F.col("_metadata.file_name"), F.lit("%28AUDIT%29")))
    damaged = F.col("damaged_text").isNotNull() | F.col("messages").isNull()
    return rows.select("day", "title", "saved_at", "model_name", F.coalesce(F.size("messages"), F.lit(0)).alias("message_count"), _lean(F.col("messages")).alias("messages"), damaged.alias("damaged"))


def damage(conversations: DataFrame) -> DataFrame:
    """(day, whole, damaged): how many conversations of each day could be read."""
    return conversations.groupBy("day").agg(F.count_if(~F.col("damaged")).alias("whole"), F.count_if("damaged").alias("damaged"))
