"""Session settings that the engine relies on, and tables that it writes on the way."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def make_session(app: str = "ledgerloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").getOrCreate()


def settle(spark: SparkSession) -> SparkSession:
    """Spark's own sizes of Arrow batches, whatever a query before has set for its texts."""
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"):
        spark.conf.unset(name)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a local one only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
    return found.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: what is read more than once is made once, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def at_exit():
        try:
            drop(spark, path)
        except Exception:  # the session has ended before; the shared folder's owner cleans up
            pass

    atexit.register(at_exit)
    return spark.read.schema(df.schema).parquet(path)
