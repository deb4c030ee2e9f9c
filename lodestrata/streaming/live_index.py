"""A keyword index that follows its documents.

Changes come in epochs. An epoch appends the postings of new and changed documents, the ids that it ends (tombstones), and the change in document
frequencies, counted up for what came and down for what went; nothing written before is touched. A version is one small file that lists the epochs
and the corpus counts; it appears last and as a whole, so a reader finds either the version before an epoch or the one after it, and what a halted
epoch left behind is overwritten by the next. Content that didn't change writes no epoch. compact() makes one epoch of all that is alive.

    root/docs/epoch=E/part=P      id, hash, dl, terms array<struct<term, tf>>: what a removal has to take back
    root/postings/epoch=E/bucket=B   term, id, tf, dl, sorted by term
    root/terms/epoch=E/bucket=B   term, df (signed)
    root/gone/epoch=E             id
    root/versions/000000012.json

Postings are dealt by a hash of their term and sorted in their files: the terms of few queries reach the scan as folders and as a filter. They are never
shuffled: a task writes the postings of the documents that it reads, a sorted file a bucket, and compaction those of the files that it reads, so a bucket has
at most as many files as there were tasks.

Defined cases: rows without an id are skipped; a null text is empty and counts as a document; of rows that repeat an id in one batch the one with the
largest hash stands; an id both changed and removed in one batch is removed; removing an unknown id does nothing; a batch number that has
been applied before is not applied again; a damaged newest version gives way to the one before.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import counted
from ..operators import search
from ..sources import files

#: Queries of at most so many distinct terms together reach the scan as a filter; more meet the index by a join.
PUSHED_TERMS = 2000
#: Bytes of texts, of documents' or of postings' files that a task takes: their postings, some 80 bytes each to sort, fit its memory.
TEXTS, FILES = 32 << 20, 16 << 20
#: Tombstones of at most so many rows are broadcast; more are joined by a shuffle.
SMALL_GONE = 1_000_000


@dataclass(frozen=True)
class Version:
    number: int = 0
    epochs: list[int] = field(default_factory=list)
    ended: list[int] = field(default_factory=list)  # epochs with tombstones
    n_gone: int = 0
    n: int = 0
    total: int = 0
    batch: int = -1
    buckets: int = 32
    kind: str = "string"  # of ids


class LiveIndex:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 32, stopwords: bool = True) -> None:
        self.spark, self.root, self.buckets, self.stopwords = spark, root.rstrip("/"), buckets, stopwords

    def version(self) -> Version:
        """The newest whole version; an empty one before the first."""
        for name in reversed(files.names(self.spark, f"{self.root}/versions")):
            try:
                return Version(**json.loads(files.read_text(self.spark, f"{self.root}/versions/{name}")))
            except (ValueError, TypeError):  # cut short or foreign: the one before it counts
                continue
        return Version(buckets=self.buckets)

    def _commit(self, version: Version) -> Version:
        files.put_text(self.spark, f"{self.root}/versions/{version.number:09d}.json", json.dumps(asdict(version)))
        return version

    def _next(self) -> int:
        """A number above every version's, whole or not, so that a damaged file is never in the way."""
        taken = [n for n in files.names(self.spark, f"{self.root}/versions") if n.endswith(".json")]
        return max([0, *(int(n.removesuffix(".json")) for n in taken)]) + 1

    def _narrow(self) -> LiveIndex:
        """The same index in a session of its own, whose tasks read FILES bytes at most."""
        spark = self.spark.newSession()
        spark.conf.set("spark.sql.files.maxPartitionBytes", FILES)
        spark.conf.set("spark.sql.files.openCostInBytes", FILES >> 8)
        return LiveIndex(spark, self.root, self.buckets, self.stopwords)

    def _table(self, name: str, epochs: list[int], schema: str) -> DataFrame:
        if not epochs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*(f"{self.root}/{name}/epoch={e}" for e in epochs))

    def _alive(self, rows: DataFrame, version: Version, kind: str) -> DataFrame:
        """Rows (id, epoch, ...) that no later epoch ends."""
        if not version.ended:
            return rows
        ends = self._table("gone", version.ended, f"id {kind}, epoch int").groupBy("id").agg(F.max("epoch").alias("ends"))
        ends = F.broadcast(ends) if version.n_gone <= SMALL_GONE else ends
        return rows.join(ends, "id", "left").where(F.col("ends").isNull() | (F.col("epoch") >= F.col("ends"))).drop("ends")

    def documents(self, version: Version | None = None) -> DataFrame:
        """(id, hash, dl, terms, epoch, part) of the documents that are alive."""
        version = version or self.version()
        kind = version.kind
        docs = self._table("docs", version.epochs, f"id {kind}, hash string, dl int, terms array<struct<term: string, tf: bigint>>, epoch int, part int")
        return self._alive(docs, version, kind)

    def _part(self, key: Column, version: Version) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(version.buckets)).cast("int")

    def _analysed(self, docs: DataFrame) -> DataFrame:
        """Documents (id, hash, text, ...) with dl and terms instead of the text. Terms are counted within each text's row, so nothing is shuffled."""
        ts = docs.withColumn("ts", X.tokens(F.col("text"), self.stopwords)).drop("text")
        return ts.withColumns({"dl": F.size("ts"), "terms": counted(F.col("ts"))}).drop("ts")

    def _write_documents(self, number: int, analysed: DataFrame) -> tuple[DataFrame, int, int]:
        """An epoch's documents (id, hash, dl, terms, part), as written, how many there are, and their tokens."""
        kind, at = dict(analysed.dtypes)["id"], f"{self.root}/docs/epoch={number}"
        analysed.select("id", "hash", "dl", "terms", "part").write.mode("overwrite").partitionBy("part").parquet(at)
        docs = self.spark.read.schema(f"id {kind}, hash string, dl int, terms array<struct<term: string, tf: bigint>>, part int").parquet(at)
        return docs, *docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()

    def _write_postings(self, number: int, postings: DataFrame) -> None:
        """An epoch's postings (term, id, tf, dl, bucket): every task sorts and writes its own."""
        rows = postings.select("term", "id", "tf", "dl", "bucket").sortWithinPartitions("bucket", "term", "id")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings/epoch={number}")

    def _write_terms(self, version: Version, number: int, changes: DataFrame) -> None:
        """An epoch's document frequencies, from signed changes (term, d)."""
        deltas = changes.groupBy("term").agg(F.sum("d").alias("df")).where("df <> 0").withColumn("bucket", self._part(F.col("term"), version))
        deltas.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/terms/epoch={number}")

    def _write(self, version: Version, number: int, analysed: DataFrame, gone: DataFrame | None) -> tuple[int, int, int, int]:
        """An epoch's tables of documents (id, hash, dl, terms, part); gone has the rows of documents() that end. Returns how many documents and tokens came and went."""
        docs, came, tokens = self._write_documents(number, analysed)
        narrow = self._narrow().spark.read.schema(docs.schema).parquet(f"{self.root}/docs/epoch={number}")
        dealt = narrow.select("id", "dl", F.explode("terms").alias("t")).select("t.term", "id", "t.tf", "dl")
        self._write_postings(number, dealt.withColumn("bucket", self._part(F.col("term"), version)))
        changes = docs.select(F.explode("terms.term").alias("term"), F.lit(1).alias("d"))
        went = (0, 0)
        if gone is not None:
            gone.select("id").write.mode("overwrite").parquet(f"{self.root}/gone/epoch={number}")
            changes = changes.unionByName(gone.select(F.explode("terms.term").alias("term"), F.lit(-1).alias("d")))
            went = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        self._write_terms(version, number, changes)
        return came, tokens, went[0], went[1]

    def apply(self, changes: DataFrame, removed: DataFrame | None = None, batch: int | None = None) -> Version:
        """Index new and changed documents (id, text) and end removed ones (id). A batch number makes a repeated call do nothing."""
        version = self.version()
        if batch is not None and batch <= version.batch:
            return version
        told = replace(version, batch=version.batch if batch is None else batch, kind=version.kind if version.epochs else dict(changes.dtypes)["id"])
        came = changes.where(F.col("id").isNotNull()).select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))
        facts = {"was": F.lit(None).cast("string"), "ended": F.lit(False)}  # what else is known of an id: the hash it has, and whether it is removed
        known = [came.withColumns(facts)]
        if version.epochs:
            known.append(self.documents(version).select("id", F.col("hash").alias("was")))
        if removed is not None:
            known.append(removed.where("id IS NOT NULL").select("id", F.lit(True).alias("ended")))
        every = known[0]
        for more in known[1:]:
            every = every.unionByName(more, allowMissingColumns=True)
        # texts are shuffled once, to the task that writes their postings; the changes of ids are found without them
        met = every.repartition(search.tasks(came, TEXTS), "id").groupBy("id").agg(F.max(F.when(F.col("hash").isNotNull(), F.struct("hash", "text"))).alias("d"), F.max("was").alias("was"), F.max("ended").alias("ended"))
        new = met.where("d IS NOT NULL AND NOT coalesce(ended, false) AND NOT d.hash <=> was").select("id", "d.hash", "d.text", self._part(F.col("id"), version).alias("part"))
        gone = ids = None
        if version.epochs:
            states = every.groupBy("id").agg(F.max("hash").alias("hash"), F.max("was").alias("was"), F.max("ended").alias("ended"))
            ids = states.where("was IS NOT NULL AND (coalesce(ended, false) OR hash <> was)").select("id").persist()
            gone = self.documents(version).join(F.broadcast(ids) if ids.count() <= SMALL_GONE else ids, "id", "left_semi").persist()
        number = self._next()
        try:
            arrived, tokens, went, less = self._write(version, number, self._analysed(new), gone)
        finally:
            if gone is not None:
                gone.unpersist()
                ids.unpersist()
        if not arrived and not went and version.epochs:
            for name in ("docs", "postings", "terms", "gone"):
                files.remove(self.spark, f"{self.root}/{name}/epoch={number}")
            return version if batch is None else self._commit(replace(told, number=number))
        ended = [*version.ended, number] if went else version.ended
        return self._commit(replace(told, number=number, epochs=[*version.epochs, number], ended=ended, n_gone=version.n_gone + went, n=version.n + arrived - went, total=version.total + tokens - less))

    def sync(self, live: DataFrame) -> Version:
        """Bring the index to the documents (id, text) that there are now: new and changed ones come, all others go. A first call indexes everything."""
        version = self.version()
        gone = self.documents(version).select("id").join(live.select("id"), "id", "left_anti") if version.epochs else None
        return self.apply(live, gone)

    def index(self, queries: DataFrame | None = None) -> search.Index:
        """The index as search.bm25 takes it. With queries (qid, query) only their terms are read: by folders and a pushed filter if they are few."""
        version = self.version()
        if not version.epochs:
            none = self.spark.createDataFrame([], "term string, id string, tf long, dl int")
            return search.Index(none, none.select("term", F.col("tf").alias("df")), 0, 1.0)
        kind = version.kind
        postings = self._table("postings", version.epochs, f"term string, id {kind}, tf long, dl int, epoch int, bucket int")
        deltas = self._table("terms", version.epochs, "term string, df long, epoch int, bucket int")
        if queries is not None:
            wanted = search.query_terms(queries, self.stopwords).select("term").distinct()
            few = [r.term for r in wanted.limit(PUSHED_TERMS + 1).collect()]
            if len(few) <= PUSHED_TERMS:
                where = self.spark.createDataFrame([(t,) for t in few], "term string").select(self._part(F.col("term"), version).alias("b")).distinct()
                hit = F.col("bucket").isin([r.b for r in where.collect()]) & F.col("term").isin(few)
                postings, deltas = postings.where(hit), deltas.where(hit)
            else:
                postings, deltas = postings.join(wanted, "term", "left_semi"), deltas.join(wanted, "term", "left_semi")
        terms = deltas.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return search.Index(self._alive(postings, version, kind).select("term", "id", "tf", "dl"), terms, version.n, version.total / version.n if version.n else 1.0)

    def compact(self) -> Version:
        """One epoch of all that is alive; readers change over with its version."""
        version = self.version()
        if not version.epochs:
            return version
        number, narrow = self._next(), self._narrow()
        _, came, tokens = self._write_documents(number, narrow.documents(version))
        postings = narrow._table("postings", version.epochs, f"term string, id {version.kind}, tf long, dl int, epoch int, bucket int")
        narrow._write_postings(number, narrow._alive(postings, version, version.kind))
        self._write_terms(version, number, self._table("terms", version.epochs, "term string, df long, epoch int, bucket int").select("term", F.col("df").alias("d")))
        return self._commit(replace(version, number=number, epochs=[number], ended=[], n_gone=0, n=came, total=tokens))

    def vacuum(self) -> None:
        """Remove epochs and versions that the newest version doesn't need. Readers of older versions must have ended."""
        version = self.version()
        for name in files.names(self.spark, f"{self.root}/versions"):
            if name != f"{version.number:09d}.json":
                files.remove(self.spark, f"{self.root}/versions/{name}")
        for table in ("docs", "postings", "terms", "gone"):
            for name in files.names(self.spark, f"{self.root}/{table}"):
                if int(name.removeprefix("epoch=")) not in version.epochs:
                    files.remove(self.spark, f"{self.root}/{table}/{name}")

    def status(self) -> dict[str, int]:
        """Documents, tokens, epochs, bytes on disk and the time of the last write in milliseconds."""
        version = self.version()
        size, last = files.total_bytes(self.spark, self.root)
        return {"documents": version.n, "tokens": version.total, "epochs": len(version.epochs), "bytes": size, "last_write": last}

    def follow(self, stream: DataFrame, text_of, checkpoint: str, available_now: bool = False):
        """Keep the index up to date with a stream of debounced events (path, last_kind, last_ts). text_of(paths) returns (id, text) of the paths that exist."""

        def step(batch: DataFrame, number: int) -> None:
            last = batch.groupBy("path").agg(F.max_by("last_kind", "last_ts").alias("kind")).persist()
            try:
                live = last.where("kind IN ('add', 'change')").select("path")
                folders = last.where("kind = 'unlinkDir'").select("path")
                ended = last.where("kind = 'unlink'").select(F.col("path").alias("id"))
                version = self.version()
                if version.epochs:
                    from .maintain import folders_of

                    known = self.documents(version).select("id")
                    inside = known.select("id", F.explode(folders_of(F.col("id"))).alias("path")).join(folders, "path", "left_semi").select("id").distinct()
                    ended = ended.unionByName(inside.join(live.select(F.col("path").alias("id")), "id", "left_anti"))
                self.apply(text_of(live), ended, number)
            finally:
                last.unpersist()

        query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(step)
        return (query.trigger(availableNow=True) if available_now else query).start()
