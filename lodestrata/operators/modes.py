"""Whether and how a message searches, by the session's mode and the message's tag: a decision table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

MODES, TAGS = ("auto", "manual", "off"), ("manual", "keyword", "exact")
# Mode, tag (None: any), enabled, force, search_mode; the first row that fits decides.
RULES = (
    ("off", None, False, False, "keyword"),
    (None, "keyword", True, True, "keyword"),
    (None, "exact", True, True, "keyword"),
    (None, "manual", True, True, "hybrid"),
    ("manual", None, False, False, "hybrid"),
    (None, None, True, False, "hybrid"),
)
_OTHER = "*"  # stands for every mode that isn't listed, and for no tag


def resolve(messages: DataFrame) -> DataFrame:
    """messages (text, mode, ...) with tag, rest (the text without its tag), enabled, force, search_mode. A null or unknown mode counts as auto.

    Rules with wildcards meet every pair of mode and tag, sixteen at most, by their priority; messages meet the outcome by an equal key.
    """
    spark = messages.sparkSession
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "place int, rule_mode string, rule_tag string, enabled boolean, force boolean, search_mode string")
    pairs = spark.createDataFrame([(m, t) for m in (*MODES, _OTHER) for t in (*TAGS, _OTHER)], "mode_key string, tag_key string")
    fits = (F.col("rule_mode").isNull() | (F.col("rule_mode") == F.col("mode_key"))) & (F.col("rule_tag").isNull() | (F.col("rule_tag") == F.col("tag_key")))
    outcome = F.min(F.struct("place", "enabled", "force", "search_mode")).alias("o")
    table = pairs.join(F.broadcast(rules), fits).groupBy("mode_key", "tag_key").agg(outcome).select("mode_key", "tag_key", "o.enabled", "o.force", "o.search_mode")
    mode = F.lower("mode")
    tag = X.search_tag(F.col("text"))
    keyed = messages.withColumns({
        "tag": tag, "rest": F.when(tag.isNull(), F.coalesce("text", F.lit(""))).otherwise(X.trimmed(F.regexp_replace("text", r"(?i)^\s*@rag(?::(?:keyword|exact))?", ""))),
        "mode_key": F.when(mode.isin(*MODES), mode).otherwise(_OTHER), "tag_key": F.coalesce(tag, F.lit(_OTHER)),
    })
    return keyed.join(F.broadcast(table), ["mode_key", "tag_key"]).drop("mode_key", "tag_key")
