"""Small files and folders on whatever file system a path belongs to, through Spark's own clients."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as Spark names files."""
    where, fs = _at(spark, path)
    return fs.makeQualified(where).toString()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it doesn't exist."""
    where, fs = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def total_bytes(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Bytes of a folder's files, and when the last of them was written (milliseconds); zeros if it doesn't exist."""
    where, fs = _at(spark, folder)
    size = last = 0
    if fs.exists(where):
        found = fs.listFiles(where, True)
        while found.hasNext():
            s = found.next()
            size, last = size + s.getLen(), max(last, s.getModificationTime())
    return size, last


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Create a file as a whole: it is written under another name first and renamed, so that no reader sees a part of it. Fails if it exists."""
    where, fs = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(part)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(where) or not fs.rename(part, where):
        fs.delete(part, False)
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new name under the shared folder in spark.checkpoint.dir (a local one only where that is unset and the session is local), removed when the process ends."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrata-"))
        root = sc.getCheckpointDir()
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def clear() -> None:
        with contextlib.suppress(Exception):  # the JVM has ended first; the folder is the cluster's to clear
            remove(spark, path)

    atexit.register(clear)
    return path
