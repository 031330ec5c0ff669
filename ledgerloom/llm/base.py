"""Session plumbing that every corpus operator shares."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.workers import share_code

#: Most rows and bytes of an Arrow batch: what a Python worker and the JVM's buffers hold at once.
BATCH_ROWS, BATCH_BYTES = 256, "1m"


def tune(spark: SparkSession) -> SparkSession:
    share_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # a finished query's shuffle files go at once: what is read again has been written by cut()
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def workdir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a local one only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session has ended before; the shared folder's owner cleans up
        pass


_scratch: list[list[Cut]] = []


@contextmanager
def scratch():
    """Tables cut within are dropped at its end; what it yields writes a table that stays."""
    _scratch.append([])
    stays: list[Cut] = []

    def keep(df: DataFrame, label: str) -> None:
        stays.append(Cut(df, label))

    try:
        yield keep, stays
    finally:
        for table in _scratch.pop():
            if table not in stays:
                table.drop()
    if _scratch:
        _scratch[-1] += stays


class Cut:
    """A written intermediate table: lineage ends at its files, so a lost executor costs no recomputation."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{workdir(self.spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.schema = df.schema
        atexit.register(_drop_at_exit, self.spark, self.path)
        if _scratch:
            _scratch[-1].append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def cut(df: DataFrame, label: str) -> DataFrame:
    return Cut(df, label).df


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def drawn(key: Column, at_most: int, rows: int, seed: int = 0) -> Column:
    """Whether a row belongs to a sample of about at_most of `rows` keys: its hash, of all 64 bits, lies under a threshold."""
    if rows <= at_most:
        return F.lit(True)
    return F.xxhash64(key, F.lit(seed)) < F.lit(at_most * 2**64 // rows - 2**63)


def whole_texts(rows: DataFrame, most_bytes: int) -> list:
    """(doc_id, text, label) of a bounded sample on the driver, in order of doc_id: one row an id, the least text and label.

    If the texts hold more than most_bytes, a further sample of about so many bytes is taken, of whole texts.
    """
    one = cut(rows.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("r")).select("doc_id", "r.text", "r.label"), "sample")
    size = one.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return sorted(one.filter(drawn(F.col("doc_id"), most_bytes, size, 1)).collect(), key=lambda r: r["doc_id"])


#: Rows of one key from which join_hot may treat it apart, and keys at most that it does.
HOT_ROWS, MOST_HOT = 100_000, 10_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", least: int | None = None, rows: int | None = None) -> DataFrame:
    """left (of `rows` rows at most) joined with right (one row a key), where a few keys may hold most rows of left.

    Keys with more than `least` rows and more than the MOST_HOT-th part of all are MOST_HOT at most: what right has of them
    is broadcast, so their rows stay where they are.
    """
    rows = left.count() if rows is None else rows
    limit = max(HOT_ROWS if least is None else least, rows // MOST_HOT)
    if rows <= limit:
        return left.join(right, keys, how)
    hot = cut(left.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > limit).select(*keys), "hot")
    if hot.isEmpty():
        return left.join(right, keys, how)
    few = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    return left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how).unionByName(left.join(F.broadcast(hot), keys, "left_semi").join(few, keys, how))


def trim() -> None:
    """Gives freed memory back to the system: workers live on, and other stages need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(f):
    """f, a function from batches to batches, with trim() after the last."""

    def run(batches):
        yield from f(batches)
        trim()

    return run


class WordCache(dict):
    """word -> value for words met before in this worker; emptied at `most` words to bound memory."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value
