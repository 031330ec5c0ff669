"""Tick and order-event views over the `events` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSIONS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def nanoseconds(ts: str = "ts") -> Column:
    """Epoch nanoseconds of a microsecond timestamp, as a long all the way."""
    return F.unix_micros(F.col(ts).cast("timestamp")) * F.lit(1000)


def numbered(df: DataFrame, session: str, order: list[str], bucket: Column, **running: Column) -> DataFrame:
    """`row_id` from 0 in each session's order, and running sums, without gathering a session in one task.

    Rows are ordered within (session, bucket); buckets must ascend with the order. Each bucket's start is the sum over
    the buckets before it, made from one row a bucket.
    """
    with_bucket = df.withColumn("_bucket", bucket)
    for name, value in running.items():
        with_bucket = with_bucket.withColumn(f"_{name}", value.cast("bigint"))
    sums = with_bucket.groupBy(session, "_bucket").agg(F.count("*").alias("_rows"), *(F.sum(f"_{n}").alias(f"_sum_{n}") for n in running))
    before = Window.partitionBy(session).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(session, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"), *(F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in running))
    own = Window.partitionBy(session, "_bucket").orderBy(*order)
    found = with_bucket.withColumn("_at", F.row_number().over(own) - 1)
    for n in running:
        found = found.withColumn(f"_run_{n}", F.sum(f"_{n}").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.join(starts, [session, "_bucket"])
    found = found.withColumn("row_id", F.col("_start") + F.col("_at"))
    for n in running:
        found = found.withColumn(n, F.col(f"_start_{n}") + F.col(f"_run_{n}"))
    return found.select(*df.columns, "row_id", *running)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, row_id, event_id, ts, mid, brk, run of every event; a break starts a new run and isn't part of it."""
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % SESSIONS).alias("session"),
        "event_id",
        "ts",
        F.col("value").alias("mid"),
        ((key_of() == 0) | (F.col("value") <= 0)).alias("brk"),
    )
    return numbered(rows, "session", ["ts", "event_id"], F.to_date("ts"), run=F.col("brk").cast("int")).select("session", "row_id", "event_id", "ts", "mid", "brk", "run")


def mbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, source_row, ts, action, side, price, size, order_id, is_last."""
    k, buy = key_of(), F.floor(F.col("user_id") / SESSIONS) % 2 == 0
    action = F.create_map(*(F.lit(x) for pair in (("signup", "A"), ("view", "M"), ("purchase", "C"), ("click", "A"), ("error", "N")) for x in pair))
    step = 0.25 * (1 + k % 20)
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % SESSIONS).alias("session"),
        F.col("event_id").alias("source_row"),
        nanoseconds().alias("ts"),
        action[F.col("event_type")].alias("action"),
        F.when(buy, "BUY").otherwise("SELL").alias("side"),
        F.when(buy, 100 - step).otherwise(100 + step).alias("price"),
        (1 + F.floor("value")).cast("double").alias("size"),
        F.col("user_id").alias("order_id"),
        (F.col("event_id") % 3 != 0).alias("is_last"),
    )


#: Rows of a generated session that are summed in one task.
SPAN = 1 << 16


def generate_sessions(spark: SparkSession, sessions: int, rows: int, seed: int = 0) -> DataFrame:
    """A deterministic stand-in for a market simulator: tick rows whose price is a hash-driven walk, any partitioning.

    Prices and clocks are running sums of hashes, made in spans of rows, so a long session isn't one task's.
    """
    at = F.col("id")
    base = spark.range(sessions * rows).select(F.call_function("div", at, F.lit(rows)).alias("session"), (at % rows).alias("place"))
    step = F.pmod(F.xxhash64("session", "place", F.lit(seed)), F.lit(3)) - 1
    gap = F.pmod(F.xxhash64("place", "session", F.lit(seed + 1)), F.lit(1_000_000)) + 1
    found = numbered(base, "session", ["place"], F.call_function("div", F.col("place"), F.lit(SPAN)), walk=step, ts=gap)
    return found.select("session", "row_id", "ts", (F.lit(10_000) + F.col("walk")).cast("double").alias("mid"), F.lit(0).alias("segment"))
