"""Streams that remember: files whose content changed, messages put together from their pieces, progress reports.

Keyed state needs the RocksDB store: set spark.sql.streaming.stateStore.providerClass to STORE before a query starts.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PIECES = "array<struct<seq: bigint, kind: string, slot: int, call_id: string, name: string, piece: string>>"


def keep_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _LastHash(StatefulProcessor):
    """Passes on a file's rows whose hash isn't the one before; a removal is passed on once and forgets the file."""

    def __init__(self, columns: list[str], ttl: int | None) -> None:
        self.columns, self.ttl = columns, ttl

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "hash string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable")
        known = self.last.get()[0] if self.last.exists() else None
        before, keep = known, []
        for hash_ in frame["file_hash"]:
            hash_ = None if pd.isna(hash_) else hash_
            keep.append(hash_ != known)
            known = hash_
        if known is None:
            self.last.clear()
        elif known != before or self.ttl:
            self.last.update((known,))
        yield frame.loc[keep, self.columns]

    def close(self) -> None:
        pass


def changed_content(stream: DataFrame, ttl: int | None = None) -> DataFrame:
    """Rows of a stream (layer, path, file_hash, ts, ...) whose content differs from the last seen of their file; a null hash is a removal.

    One hash a file is kept, and after ttl milliseconds without the file none: it counts as new then. Rows of one file that come together are
    taken in the order of ts.
    """
    return stream.groupBy("layer", "path").transformWithStateInPandas(
        statefulProcessor=_LastHash(stream.columns, ttl), outputStructType=stream.schema, outputMode="Append", timeMode="ProcessingTime" if ttl else "None"
    )


def changed_rows(files: DataFrame) -> DataFrame:
    """What changed_content passes on of a table."""
    from pyspark.sql import Window

    before = F.lag("file_hash").over(Window.partitionBy("layer", "path").orderBy("ts"))
    return files.withColumn("hash_before", before).where(~F.col("file_hash").eqNullSafe(F.col("hash_before"))).drop("hash_before")


class _Pieces(StatefulProcessor):
    """Holds the pieces of a message until its end mark and all before it are there."""

    def __init__(self, key: str, ttl: int | None) -> None:
        self.key, self.ttl = key, ttl

    def init(self, handle) -> None:
        self.pieces = handle.getMapState("pieces", "seq long", "kind string, slot int, call_id string, name string, piece string", self.ttl)
        self.told = handle.getValueState("told", "done boolean", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.told.exists():  # pieces that come again after the end
            return
        for frame in rows:
            for r in frame.astype(object).where(frame.notna(), None).itertuples():
                if not self.pieces.containsKey((int(r.seq),)):
                    self.pieces.updateValue((int(r.seq),), (r.kind, None if r.slot is None else int(r.slot), r.call_id, r.name, r.piece))
        held = {k[0]: tuple(v) for k, v in self.pieces.iterator()}
        end = next((s for s, v in held.items() if v[0] == "end"), None)
        if end is not None and all(s in held for s in range(end)):
            self.pieces.clear()
            self.told.update((True,))
            yield pd.DataFrame({self.key: [key[0]], "pieces": [[dict(zip(("seq", "kind", "slot", "call_id", "name", "piece"), (s, *held[s]), strict=True)) for s in range(end + 1)]]})

    def close(self) -> None:
        pass


def _joined(pieces: Column, which: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.filter(pieces, which), lambda p: F.coalesce(p["piece"], F.lit(""))), "")


def _message(key: str, pieces: Column) -> list[Column]:
    """Reasoning, content, usage and calls of the ordered pieces of a whole message; a call has its first id and name, and its arguments joined."""
    kind = lambda k: lambda p: p["kind"] == k
    calls = F.filter(pieces, kind("call"))
    first = lambda own, c: F.get(F.filter(F.transform(own, lambda p: p[c]), lambda x: x.isNotNull()), F.lit(0))

    def call(slot: Column) -> Column:
        own = F.filter(calls, lambda p: p["slot"] == slot)
        return F.struct(slot.alias("slot"), first(own, "call_id").alias("id"), F.coalesce(first(own, "name"), F.lit("")).alias("name"), _joined(own, lambda p: F.lit(True)).alias("arguments"))

    slots = F.array_sort(F.array_distinct(F.transform(calls, lambda p: p["slot"])))
    usage = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(pieces, kind("usage")), lambda p: p["piece"])), -1)
    return [F.col(key), _joined(pieces, kind("reasoning")).alias("reasoning"), _joined(pieces, kind("content")).alias("content"), usage.alias("usage"), F.transform(slots, call).alias("tool_calls")]


def assemble_stream(stream: DataFrame, key: str = "message_id", ttl: int | None = None) -> DataFrame:
    """Whole messages of a stream of pieces (key, seq from 0, kind, slot, call_id, name, piece), each once, when its end mark and all before it have come.

    kind is reasoning, content, call (of the slot that its call has in the message), usage or end. Pieces come in any order and more than once. Unfinished messages
    are forgotten ttl milliseconds after their last piece, if that is given.
    """
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    out = T.StructType([T.StructField(key, kinds[key]), T.StructField("pieces", T._parse_datatype_string(PIECES))])
    rows = stream.select(key, F.col("seq").cast("long").alias("seq"), "kind", F.col("slot").cast("int").alias("slot"), "call_id", "name", "piece")
    whole = rows.groupBy(key).transformWithStateInPandas(statefulProcessor=_Pieces(key, ttl), outputStructType=out, outputMode="Append", timeMode="ProcessingTime" if ttl else "None")
    return whole.select(_message(key, F.col("pieces")))


def assemble(deltas: DataFrame, key: str = "message_id") -> DataFrame:
    """What assemble_stream gives, of a table: messages without an end mark or with a gap before it are left out."""
    piece = F.struct(F.col("seq").cast("long").alias("seq"), "kind", F.col("slot").cast("int").alias("slot"), "call_id", "name", "piece")
    once = deltas.groupBy(key, "seq").agg(F.min(piece).alias("p"))
    held = once.groupBy(key).agg(F.sort_array(F.collect_list("p")).alias("pieces"), F.min(F.when(F.col("p.kind") == "end", F.col("seq"))).alias("end"))
    upto = F.filter("pieces", lambda p: p["seq"] <= F.col("end"))
    return held.where(F.col("end").isNotNull()).withColumn("pieces", upto).where(F.size("pieces") == F.col("end") + 1).select(_message(key, F.col("pieces")))


def counted(stream: DataFrame, name: str = "indexed") -> DataFrame:
    """A stream that tells how many rows, and how many distinct paths about, each of its batches had."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("path").alias("paths"))


class Progress(StreamingQueryListener):
    """Reports of a query's observed metrics, summed since the last report: one at most in every seconds, and one at the end."""

    def __init__(self, report: Callable[[dict], None], name: str = "indexed", every: float = 2.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.report, self.name, self.every, self.clock = report, name, every, clock
        self.last, self.open = -float("inf"), {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = (event.progress.observedMetrics or {}).get(self.name)
        if row is None:
            return
        for k, v in row.asDict().items():
            self.open[k] = self.open.get(k, 0) + (v or 0)
        self.open["batch"] = event.progress.batchId
        if self.clock() - self.last >= self.every:
            self._tell()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if self.open:
            self._tell()

    def _tell(self) -> None:
        self.last, told, self.open = self.clock(), self.open, {}
        self.report(told)


def json_reports(spark: SparkSession, folder: str) -> Callable[[dict], None]:
    """A report function that leaves each report as a small file in a folder, named by its batch."""
    from ..sources import files

    return lambda told: files.put_text(spark, f"{folder}/{told['batch']:012d}.json", json.dumps(told) + "\n")
