"""Continuity runs, anchors, histories and futures of tick rows (session, row_id, ts, mid, brk, run)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import log_path
from ledgerloom.schema import HISTORY, HORIZON
from ledgerloom.sources.views import numbered

RUN = ["session", "run"]
#: Rows of a run that one task's window takes, besides those at its edges.
BLOCK = 1 << 16


def blocks(ticks: DataFrame, before: int, after: int) -> DataFrame:
    """The rows of runs dealt to blocks of BLOCK row ids; `_own` is false for the `before` and `after` rows at the edges.

    Windows over (session, run, _block) then see all that frames of so many rows need, and no run is one task's.
    """

    def block(row: Column) -> Column:
        return F.call_function("div", F.greatest(row, F.lit(0)), F.lit(BLOCK))

    row = F.col("row_id")
    return ticks.filter(~F.col("brk")).withColumn("_block", F.explode(F.sequence(block(row - after), block(row + before)))).withColumn("_own", F.col("_block") == block(row))


def _order():
    return Window.partitionBy(*RUN, "_block").orderBy("row_id")


def run_ids(df: DataFrame, session: str, order: str, label: str, bucket: Column) -> DataFrame:
    """`run`: a number that changes wherever the label differs from the row before, even where it came up earlier.

    bucket: ascends with the order; rows are ordered within a bucket, and what crosses buckets is one row of each.
    """
    own = Window.partitionBy(session, "_bucket").orderBy(order)
    rows = df.withColumn("_bucket", bucket).withColumn("_here", F.struct(F.col(label).alias("label"))).withColumn("_back", F.lag("_here").over(own))
    ends = rows.groupBy(session, "_bucket").agg(F.max_by("_here", order).alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(session).orderBy("_bucket"))).select(session, "_bucket", "_before")
    rows = rows.join(ends, [session, "_bucket"]).withColumn("_back", F.coalesce("_back", "_before"))
    rows = rows.withColumn("_change", F.when(F.col("_back").isNull(), 0).otherwise((~F.col("_here").eqNullSafe(F.col("_back"))).cast("int")))
    found = numbered(rows, session, [order], F.col("_bucket"), run=F.col("_change"))
    return found.select(*df.columns, "run")


def runs(ticks: DataFrame) -> DataFrame:
    """first_row, last_row, n_rows of every run."""
    return ticks.filter(~F.col("brk")).groupBy(*RUN).agg(F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"), F.count("*").alias("n_rows"))


def anchor_ranges(the_runs: DataFrame, history: int = HISTORY, horizon: int = HORIZON) -> DataFrame:
    """Half-open ranges [start, stop) of rows whose history and future lie in their run."""
    start, stop = F.col("first_row") + history - 1, F.col("last_row") - horizon + 1
    return the_runs.select(*RUN, start.alias("start"), stop.alias("stop")).filter("stop > start")


def anchors(ranges: DataFrame) -> DataFrame:
    """One row per anchor."""
    return ranges.select(*RUN, F.explode(F.sequence("start", F.col("stop") - 1)).alias("anchor"))


def anchor_batches(ranges: DataFrame, size: int) -> DataFrame:
    """Anchors of each range in arrays of at most `size`, in order."""
    begins = ranges.select(*RUN, "stop", F.explode(F.expr(f"sequence(start, stop - 1, {int(size)})")).alias("begin"))
    return begins.select(*RUN, F.sequence("begin", F.least(F.col("begin") + size, F.col("stop")) - 1).alias("anchors"))


def history_ranges(ranges: DataFrame, history: int = HISTORY) -> DataFrame:
    """Rows that any eligible history uses, as ranges (G9: each row once)."""
    return ranges.select(*RUN, (F.col("start") - history + 1).alias("start"), "stop")


def valid_anchors(ticks: DataFrame, history: int, horizon: int, start: int = 0, stop: int | None = None) -> DataFrame:
    """Anchors when only rows [start, stop) may be used."""
    rows = ticks.filter(F.col("row_id") >= start)
    return anchors(anchor_ranges(runs(rows if stop is None else rows.filter(F.col("row_id") < stop)), history, horizon))


def futures(ticks: DataFrame, horizon: int = HORIZON, history: int = 1) -> DataFrame:
    """session, run, anchor, y: the log path of the next `horizon` mids, for every eligible anchor."""
    rows = blocks(ticks, history - 1, horizon)
    rows = rows.withColumn("later", F.collect_list("mid").over(_order().rowsBetween(1, horizon))).withColumn("had", F.count("*").over(_order().rowsBetween(1 - history, 0)))
    rows = rows.filter(F.col("_own") & (F.size("later") == horizon) & (F.col("had") == history))
    return rows.select(*RUN, F.col("row_id").alias("anchor"), log_path(F.col("later"), F.col("mid")).alias("y"))


def histories(ticks: DataFrame, wanted: DataFrame, value: str, history: int = HISTORY, kind: str = "array<double>") -> DataFrame:
    """`x`, the `history` values up to each wanted (session, anchor), from frames over blocks of runs, by an equi-join.

    Fails the query on an anchor without a whole history in its run.
    """
    rows = blocks(ticks, history - 1, 0)
    rows = rows.withColumn("x", F.collect_list(value).over(_order().rowsBetween(1 - history, 0))).filter("_own").select("session", F.col("row_id").alias("anchor"), "x")
    got = wanted.select("session", "anchor").distinct().join(rows, ["session", "anchor"], "left")
    refused = F.raise_error(F.format_string("session %s: no whole history at anchor %s", F.col("session").cast("string"), F.col("anchor").cast("string")))
    return got.withColumn("x", F.when(F.size("x") == history, F.col("x")).otherwise(refused.cast(kind)))


def step_returns(ticks: DataFrame) -> DataFrame:
    """Log return on the row before in the same run; 0 at its start."""
    rows = blocks(ticks, 1, 0).withColumn("_back", F.lag("mid").over(_order())).filter("_own")
    return rows.select("session", "row_id", "run", F.when(F.col("_back").isNull(), 0.0).otherwise(F.log(F.col("mid") / F.col("_back"))).alias("step_return"))


def step_gaps(ticks: DataFrame, ns: Column) -> DataFrame:
    """Seconds since the row before in the same run; rows at a run's start have none."""
    rows = blocks(ticks, 1, 0).withColumn("_ns", ns).withColumn("_back", F.lag("_ns").over(_order())).filter("_own")
    return rows.filter(F.col("_back").isNotNull()).select("session", "row_id", "event_id", ((F.col("_ns") - F.col("_back")) / 1e9).alias("gap"))


def future_spans(ticks: DataFrame, horizon: int, ns: Column) -> DataFrame:
    """Seconds until `horizon` rows later in the same run."""
    rows = blocks(ticks, 0, horizon).withColumn("_ns", ns).withColumn("_then", F.lead("_ns", horizon).over(_order()))
    return rows.filter(F.col("_own") & F.col("_then").isNotNull()).select("session", "row_id", ((F.col("_then") - F.col("_ns")) / 1e9).alias("seconds"))


def zero_paths(ticks: DataFrame, horizon: int) -> DataFrame:
    """Whether the mid stays the same for `horizon` rows, by equal running counts of its changes."""
    change = F.coalesce((F.col("mid") != F.lag("mid").over(_order())).cast("int"), F.lit(0))
    rows = blocks(ticks, 0, horizon).withColumn("_c", change).withColumn("_n", F.sum("_c").over(_order()))
    rows = rows.withColumn("unchanged", F.lead("_n", horizon).over(_order()) == F.col("_n"))
    return rows.filter(F.col("_own") & F.col("unchanged").isNotNull()).select("session", "row_id", "unchanged")


def clock_regressions(df: DataFrame, session: str, order: str, ns: str, bucket: Column) -> DataFrame:
    """Rows whose clock lies before that of the row before; bucket: ascends with the order, as in run_ids."""
    own = Window.partitionBy(session, "_bucket").orderBy(order)
    rows = df.withColumn("_bucket", bucket).withColumn("_back", F.lag(ns).over(own))
    ends = rows.groupBy(session, "_bucket").agg(F.max_by(ns, order).alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(session).orderBy("_bucket"))).select(session, "_bucket", "_before")
    rows = rows.join(ends, [session, "_bucket"]).withColumn("before_ns", F.coalesce("_back", "_before"))
    return rows.filter(F.col(ns) < F.col("before_ns")).select(*df.columns, "before_ns")


def interval_gaps(df: DataFrame, start: str, stop: str, keys: list[str]) -> DataFrame:
    """Stretches that no interval covers, by the running end of those before."""
    w = Window.partitionBy(*keys).orderBy(start, stop).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("covered", F.max(stop).over(w)).filter(F.col(start) > F.col("covered")).select(*keys, F.col("covered").alias("gap_start"), F.col(start).alias("gap_stop"))


def coverage(ranges: DataFrame) -> DataFrame:
    """Disjoint ranges that hold exactly the rows of any range, per session, by a running count of open ranges."""
    marks = ranges.select("session", F.col("start").alias("at"), F.lit(1).alias("d")).unionByName(ranges.select("session", F.col("stop").alias("at"), F.lit(-1).alias("d")))
    steps = marks.groupBy("session", "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("session").orderBy("at")
    open_ = steps.withColumn("open", F.sum("d").over(w)).withColumn("was", F.coalesce(F.lag("open").over(w), F.lit(0)))
    edges = open_.filter((F.col("open") == 0) | (F.col("was") == 0)).filter((F.col("open") > 0) != (F.col("was") > 0))
    return edges.withColumn("stop", F.lead("at").over(w)).filter("open > 0").select("session", F.col("at").alias("start"), "stop")
