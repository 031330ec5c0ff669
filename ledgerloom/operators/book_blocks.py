"""Book replay by blocks of records, so that a session with most of the rows isn't one task's.

The orders alive where a block begins come from a declarative pass (an order's record holds until its next one or the next
clear), so every block starts from its own book. What crosses blocks afterwards is one row a block: the breaks so far and
the last observation, which settle segment numbers and the first row of each block.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import book
from ledgerloom.schema import DEPTH, LEVELS

BLOCK = 1 << 18
_OUT = f"session bigint, block bigint, source_row bigint, ts bigint, segment bigint, initial boolean, mid double, bids {LEVELS}, asks {LEVELS}, n_bids int, n_asks int, before_mid double, before_ts bigint, breaks bigint, joined boolean"
_LEVELS = pa.list_(pa.struct([("price", pa.float64()), ("qty", pa.float64()), ("orders", pa.int64())]))
_SCHEMA = pa.schema([
    ("session", pa.int64()), ("block", pa.int64()), ("source_row", pa.int64()), ("ts", pa.int64()), ("segment", pa.int64()), ("initial", pa.bool_()), ("mid", pa.float64()),
    ("bids", _LEVELS), ("asks", _LEVELS), ("n_bids", pa.int32()), ("n_asks", pa.int32()), ("before_mid", pa.float64()), ("before_ts", pa.int64()), ("breaks", pa.int64()), ("joined", pa.bool_()),
])


def _block(row: Column, size: int) -> Column:
    return F.call_function("div", row, F.lit(size))


def seeds(events: DataFrame, size: int = BLOCK) -> DataFrame:
    """session, block, order_id, side, price, qty: the orders alive before the block's first record."""
    clears = events.filter("action = 'R'").groupBy("session").agg(F.array_sort(F.collect_set("source_row")).alias("clears"))
    w = Window.partitionBy("session", "order_id").orderBy("source_row")
    rows = events.filter(F.col("action").isin("A", "C", "M")).withColumn("next", F.lead("source_row").over(w))
    rows = rows.filter("action <> 'C'").join(clears, "session", "left")
    clear = F.get(F.filter(F.coalesce("clears", F.array().cast("array<bigint>")), lambda c: c > F.col("source_row")), F.lit(0))
    last = events.groupBy("session").agg(F.max("source_row").alias("last"))
    rows = rows.join(last, "session").withColumn("until", F.least(F.coalesce("next", F.col("last") + 1), F.coalesce(clear, F.col("last") + 1)))
    # alive before the first record of block b: source_row < b * size <= until
    first, stop = _block(F.col("source_row"), size) + 1, _block(F.col("until"), size)
    return rows.filter(stop >= first).select("session", F.explode(F.sequence(first, stop)).alias("block"), "order_id", "side", "price", F.col("size").alias("qty"))


def replay(events: DataFrame, mode: str = "replay", depth: int = DEPTH, size: int = BLOCK) -> DataFrame:
    """The observations of book.replay(), block by block; cut the log with store.until_stop() and check its start with
    store.preflight() and its clock with runs.clock_regressions() first."""
    if "is_snapshot" not in events.columns:
        events = events.withColumn("is_snapshot", F.lit(False))
    rows = events.select("session", *book._INPUT).withColumn("block", _block(F.col("source_row"), size))
    begin = seeds(events, size).toDF("session_", "block_", "order_id_", "side_", "price_", "qty_")

    def run(key: tuple, records: pa.Table, orders: pa.Table) -> pa.Table:
        session, block = (k.as_py() for k in key)
        if not len(records):
            return pa.Table.from_pylist([], _SCHEMA)
        line = book.Timeline(mode, depth=depth)
        for x in orders.to_pylist():
            line.apply("A", x["side_"], x["price_"], x["qty_"], x["order_id_"])
        steps = (line.step([x[c] for c in book._INPUT]) for x in records.sort_by("source_row").to_pylist())
        out = [{"session": session, "block": block, **found, "joined": False} for found in steps if found]
        if out:
            # nothing broke since the block began: the first row may go on from the block before
            out[0]["joined"] = out[0]["segment"] == 0
        out.append({"session": session, "block": block, "before_mid": line.last[0], "before_ts": line.last[1], "breaks": line.segment})
        return pa.Table.from_pylist(out, _SCHEMA)

    found = rows.groupBy("session", "block").cogroup(begin.groupBy("session_", "block_")).applyInArrow(run, _OUT)
    w = Window.partitionBy("session").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row a block; what a block without observations and breaks passes on is what it got
    went_on = (F.col("breaks") == 0) & F.col("before_mid").isNull()
    told = F.when(~went_on, F.struct(F.col("before_mid").alias("mid"), F.col("before_ts").alias("ts")))
    tails = found.filter(F.col("breaks").isNotNull()).select("session", "block", F.coalesce(F.sum("breaks").over(w), F.lit(0)).alias("_breaks"), F.last(told, True).over(w).alias("_before"))
    both = found.filter(F.col("breaks").isNull()).join(tails, ["session", "block"])
    goes_on = F.col("joined") & F.col("_before.mid").isNotNull()
    return both.select(
        "session", "source_row", "ts", (F.col("segment") + F.col("_breaks")).alias("segment"), (F.col("initial") & ~goes_on).alias("initial"), "mid", "bids", "asks", "n_bids", "n_asks",
        F.when(goes_on, F.col("_before.mid")).otherwise(F.col("before_mid")).alias("before_mid"), F.when(goes_on, F.col("_before.ts")).otherwise(F.col("before_ts")).alias("before_ts"),
    )
