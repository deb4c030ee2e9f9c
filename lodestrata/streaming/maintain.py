"""Incremental maintenance from file events: debounce, change detection, an append-only chunk store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def debounce(events: DataFrame, gap: str, key: str = "path", ts: str = "ts", kind: str = "kind") -> DataFrame:
    """One row for each burst of events of a key (pauses under gap), with the last kind. Batch, or streaming with a watermark in append mode."""
    return (
        events.groupBy(F.session_window(ts, gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n_events"), F.max_by(kind, F.struct(F.col(ts), F.col(kind))).alias("last_kind"), F.max(ts).alias("last_ts"))
        .select(key, F.col("w.start").alias("start"), "last_ts", "n_events", "last_kind")
    )


def folders_of(path: Column) -> Column:
    """Every folder above a path: a/b/c lies in a and a/b."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def _last_events(events: DataFrame) -> DataFrame:
    """(path, last_kind, seq): each path's last event. Without last_ts all events of a batch have one place."""
    seq = F.unix_micros(F.col("last_ts").cast("timestamp")) if "last_ts" in events.columns else F.lit(0).cast("long")
    return events.select("path", "last_kind", seq.alias("seq")).groupBy("path").agg(F.max(F.struct("seq", "last_kind")).alias("e")).select("path", "e.last_kind", "e.seq")


def apply_events(store: DataFrame, events: DataFrame, fresh: DataFrame) -> DataFrame:
    """The chunk store after debounced events: chunks of changed and removed paths go, fresh chunks of added and changed ones come.

    events: (path, last_kind) and, if their order matters, last_ts: what comes under a folder before the folder's removal goes with it.
    """
    last = _last_events(events)
    gone = last.select(F.col("path").alias("file_path"))
    removed = last.where("last_kind = 'unlinkDir'").select("path", F.col("seq").alias("ended"))
    # a path is compared with removed folders by its own folders, so that the join is by key
    inside = store.select("file_path").distinct().select("file_path", F.explode(folders_of(F.col("file_path"))).alias("path")).join(removed, "path", "left_semi").select("file_path")
    kept = store.join(gone.unionByName(inside).distinct(), "file_path", "left_anti").select(store.columns)
    live = last.where("last_kind IN ('add', 'change')").select(F.col("path").alias("file_path"), "seq")
    under = live.select("file_path", "seq", F.explode(folders_of(F.col("file_path"))).alias("path")).join(removed, "path").where(F.col("seq") < F.col("ended")).select("file_path")
    return kept.unionByName(fresh.join(live.join(under, "file_path", "left_anti"), "file_path", "left_semi").select(store.columns))


CHUNKS, GONE = "chunks", "gone"


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """The chunks that are alive in a store that maintain() keeps.

    Events have a place in time, (seq, epoch): seq is the time of the event, epoch its batch. A chunk has its path's place when it was written; it is alive if
    no event of its path has a later place, nor the removal of a folder above it.
    """
    chunks, gone = (spark.read.parquet(f"{root}/{name}") for name in (CHUNKS, GONE))
    place = F.struct("seq", "epoch")
    last = gone.where("NOT folder").groupBy(F.col("path").alias("file_path")).agg(F.max(place).alias("ended"))
    folders = gone.where("folder").groupBy("path").agg(F.max(place).alias("ended"))
    under = chunks.select("file_path").distinct().select("file_path", F.explode(folders_of(F.col("file_path"))).alias("path")).join(folders, "path").select("file_path", "ended")
    ends = last.unionByName(under).groupBy("file_path").agg(F.max("ended").alias("ended"))
    return chunks.join(ends, "file_path", "left").where(F.col("ended").isNull() | (F.struct("seq", "epoch") >= F.col("ended"))).select([c for c in chunks.columns if c not in ("epoch", "seq")])


def write_epoch(root: str, epoch: int, batch: DataFrame, fresh: DataFrame) -> None:
    """Append one batch of debounced events (path, last_kind, last_ts) and the chunks of its added and changed paths; no earlier file is touched, a repeated epoch replaces itself."""
    last = _last_events(batch)
    live = last.where("last_kind IN ('add', 'change')").select(F.col("path").alias("file_path"), "seq")
    fresh.join(live, "file_path").select(*fresh.columns, "seq").write.mode("overwrite").parquet(f"{root}/{CHUNKS}/epoch={epoch}")
    folder = F.col("last_kind") == "unlinkDir"
    # a path's own last event and its last removal as a folder both count, whichever came first
    seq = F.unix_micros(F.col("last_ts").cast("timestamp")) if "last_ts" in batch.columns else F.lit(0).cast("long")
    batch.select("path", folder.alias("folder"), seq.alias("seq")).groupBy("path", "folder").agg(F.max("seq").alias("seq")).write.mode("overwrite").parquet(f"{root}/{GONE}/epoch={epoch}")


def compact(spark: SparkSession, root: str, target: str) -> None:
    """Write what is alive as a store of one epoch elsewhere; readers change over by its name."""
    read_store(spark, root).withColumn("seq", F.lit(-(2**63)).cast("long")).write.mode("overwrite").parquet(f"{target}/{CHUNKS}/epoch=0")
    spark.createDataFrame([], "path string, folder boolean, seq long").write.mode("overwrite").parquet(f"{target}/{GONE}/epoch=0")


def maintain(stream: DataFrame, root: str, chunks_of, checkpoint: str, gap: str = "700 milliseconds", late: str = "10 seconds", available_now: bool = False):
    """Start a query that keeps the chunk store under root up to date; read_store() reads it at any time. chunks_of(paths) returns their chunks (file_path, ...)."""

    def step(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            write_epoch(root, epoch, batch, chunks_of(batch.where("last_kind IN ('add', 'change')").select("path").distinct()))
        finally:
            batch.unpersist()

    query = debounce(stream.withWatermark("ts", late), gap).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(step)
    return (query.trigger(availableNow=True) if available_now else query).start()
