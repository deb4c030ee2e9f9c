"""What the operators of this package share: tables, scratch space, hashing, folds, worker caches."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word definition here, as characters of a regular expression class.
SPACE = r"\x20\x09-\x0D"
#: The same characters, literally.
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; one of our own only where it is unset and the session is local, as in tests."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrata-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._scratch_path = path
    remember(spark, path)
    return kept


#: Folders written and not yet removed, with the JVM that can: lazy results may read them until the process ends.
_left: dict[str, object] = {}


def remember(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the process ends, if nothing does before."""
    if not _left:
        atexit.register(_clear)
    _left[path] = spark._jvm


def _remove(jvm, path: str) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def _clear() -> None:
    for path, jvm in list(_left.items()):
        try:
            _remove(jvm, path)
        except Exception:  # noqa: BLE001 - the JVM has ended first; the folder is the cluster's to clear
            break
    _left.clear()


def drop(df: DataFrame | None) -> None:
    """Remove a table that keep() wrote, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
        _left.pop(path, None)


def local(df: DataFrame) -> pd.DataFrame:
    """A table of bounded size on the driver, by Arrow: without it each row would be Python objects first."""
    return df.toArrow().to_pandas()


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, mod parts; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def worker_cache() -> types.ModuleType:
    """State that outlives a task in a reused Python worker."""
    name = "_lodestrata_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name]


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text, A-Z lower-cased, as UTF-8; bytes.lower and bytes.split know ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def trim() -> None:
    """Give memory that a Python worker has freed back to the system: workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass
