"""Data-quality expectations, splits, reconciliation and reports over sessions of observations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import seconds_since_midnight, time_of_day_pair
from ledgerloom.operators import runs
from ledgerloom.operators.quantiles import exact_quantiles
from ledgerloom.schema import DEPTH, feature_names
from ledgerloom.session import written
from ledgerloom.sources.views import numbered


_NARROW = ["session", "source_row", "segment", "ts", "mid"]
#: What flags() says of each row, and what audit() checks: these, and the row before that each row carries.
FLAGS = (
    "width", "not_finite", "mid_not_positive", "clock_runs_back", "initial_flag", "initial_feature", "time_delta", "mid_return", "presence_flag",
    "best_absent", "absent_not_zero", "present_empty", "orders_not_whole", "hole", "order_of_prices", "not_around_mid", "spread", "time_of_day", "not_on_date",
)
NAMES = (*FLAGS, "row_before", "source_row_order")


def _broken(x: np.ndarray, mid: np.ndarray, first: np.ndarray, seconds: np.ndarray, moved: np.ndarray, tod: np.ndarray, depth: int, tolerance: float) -> dict[str, np.ndarray]:
    """name -> which rows (of the right width) break the expectation; seconds, moved: since the row before, 0 at a first row."""
    levels = x[:, : 8 * depth].reshape(len(x), 2, depth, 4)  # bids and asks: price in ticks, quantity, orders, presence
    price, quantity, orders, present = (levels[..., k] for k in range(4))
    here, best = present == 1, price[:, :, 0]
    spread, delta, back, initial, sin, cos = x[:, 8 * depth :].T
    rising = price[:, :, 1:] - price[:, :, :-1]
    return {
        "not_finite": ~np.isfinite(x).all(1),
        "mid_not_positive": ~(mid > 0),
        "clock_runs_back": seconds < 0,
        "initial_feature": initial != first,
        "time_delta": np.abs(delta - seconds) > tolerance,
        "mid_return": np.abs(back - moved) > tolerance,
        "presence_flag": ~np.isin(present, (0, 1)).all((1, 2)),
        "best_absent": ~here[:, :, 0].all(1),
        "absent_not_zero": ((present == 0) & ((price != 0) | (quantity != 0) | (orders != 0))).any((1, 2)),
        "present_empty": (here & ((quantity <= 0) | (orders <= 0))).any((1, 2)),
        "orders_not_whole": (orders != np.floor(orders)).any((1, 2)),
        "hole": ((present[:, :, :-1] == 0) & here[:, :, 1:]).any((1, 2)),
        "order_of_prices": (here[:, 0, 1:] & (rising[:, 0] >= 0)).any(1) | (here[:, 1, 1:] & (rising[:, 1] <= 0)).any(1),
        "not_around_mid": (best[:, 0] > 0) | (best[:, 1] < 0) | (np.abs(best[:, 0] + best[:, 1]) > tolerance),
        "spread": np.abs(spread - (best[:, 1] - best[:, 0])) > tolerance,
        "time_of_day": (np.abs(sin - tod[:, 0]) > tolerance) | (np.abs(cos - tod[:, 1]) > tolerance),
    }


def flags(observations: DataFrame, depth: int = DEPTH, tolerance: float = 1e-9, clock: str = "simulation", date: Column | None = None) -> DataFrame:
    """session, source_row, segment, ts, mid, before_ts, before_mid and, for each name of FLAGS, whether the row breaks it.

    Rows are judged by what they say of themselves and of the row before, which they carry, a batch at a time. A row of
    another width breaks that alone. date: the day on which clocks must lie.
    """
    width = 8 * depth + 6
    sin, cos = time_of_day_pair(seconds_since_midnight(F.col("ts"), clock))
    first = F.col("before_ts").isNull()
    off = F.lit(False) if date is None else F.coalesce(F.to_date(F.timestamp_micros(F.call_function("div", F.col("ts"), F.lit(1000)))) != date, F.lit(True))
    wide = observations.select(
        *_NARROW, "before_ts", "before_mid", "x", first.alias("first"), (F.col("initial") != first).alias("initial_flag"), off.alias("not_on_date"), F.array(sin, cos).alias("tod"),
        F.when(first, 0.0).otherwise((F.col("ts") - F.col("before_ts")) / 1e9).alias("seconds"), F.when(first, 0.0).otherwise(F.log(F.col("mid") / F.col("before_mid"))).alias("moved"),
    )
    kinds = dict(observations.dtypes)
    kept = [*_NARROW, "before_ts", "before_mid"]

    def judge(batches):
        for batch in batches:
            arrays = batch["x"]
            right = pa.compute.equal(pa.compute.list_value_length(arrays), width).fill_null(False).to_numpy(zero_copy_only=False)
            found = {name: np.zeros(len(batch), bool) for name in FLAGS}
            found["width"] = ~right
            for name in ("initial_flag", "not_on_date"):
                found[name] = batch[name].to_numpy(zero_copy_only=False).astype(bool)
            some = batch.filter(pa.array(right))
            if len(some):
                x = some["x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                tod = some["tod"].flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
                cols = (some[c].to_numpy(zero_copy_only=False).astype(float) for c in ("mid", "first", "seconds", "moved"))
                for name, bad in _broken(x, *cols, tod, depth, tolerance).items():
                    found[name][right] = bad
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *(pa.array(found[name]) for name in FLAGS)], names=[*kept, *FLAGS])

    return wide.mapInArrow(judge, ", ".join([*(f"{c} {kinds[c]}" for c in kept), *(f"{n} boolean" for n in FLAGS)]))


#: Source rows of a session that are numbered in one task.
SPAN = 1 << 18


def as_ticks(observations: DataFrame) -> DataFrame:
    """Observations as rows of runs: row_id from 0 in each session by source row, run (the segment), brk.

    They are read twice, so what is dear to make (a replay) should be written before.
    """
    rows = numbered(observations, "session", ["source_row"], F.call_function("div", F.col("source_row"), F.lit(SPAN)))
    return rows.withColumn("run", F.col("segment")).withColumn("brk", F.lit(False))


def neighbours(observations: DataFrame) -> DataFrame:
    """Observations with `_ts`, `_mid` and `_source_row` of the row before in the segment, looked up in blocks of rows."""
    w = Window.partitionBy("session", "run", "_block").orderBy("row_id")
    return runs.blocks(as_ticks(observations), 1, 0).withColumns({f"_{c}": F.lag(c).over(w) for c in ("ts", "mid", "source_row")}).filter("_own")


def audit(observations: DataFrame, depth: int = DEPTH, clock: str = "simulation", date: Column | None = None) -> DataFrame:
    """One row a session: rows, segments, clock range, and how many rows break each expectation.

    What a row says of itself and of the row before, which it carries, is judged row by row and written as flags; then the
    carried clock and mid are checked against the rows themselves, on narrow columns.
    """
    rows = written(flags(observations, depth, clock=clock, date=date), "flags")
    own = rows.groupBy("session").agg(
        F.count("*").alias("rows"), F.countDistinct("segment").alias("segments"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *(F.sum(F.col(name).cast("int")).alias(name) for name in FLAGS)
    )
    met = neighbours(rows.select(*_NARROW, "before_ts", "before_mid"))
    carried = F.col("before_ts").eqNullSafe(F.col("_ts")) & F.col("before_mid").eqNullSafe(F.col("_mid"))
    back = F.coalesce(F.col("source_row") <= F.col("_source_row"), F.lit(False))
    near = met.groupBy("session").agg(F.sum((~carried).cast("int")).alias("row_before"), F.sum(back.cast("int")).alias("source_row_order"))
    return own.join(near, "session").select("session", "rows", "segments", "first_ts", "last_ts", *NAMES)


def audit_summary(observations: DataFrame, horizon: int, depth: int = DEPTH) -> DataFrame:
    """One row a session: rows, segments, longest segment, futures, their seconds, unchanged share, absent levels, constant features."""
    observed = written(observations.select(*_NARROW, "x"), "observed")
    rows = written(as_ticks(observed.drop("x")), "ticks")
    lengths = rows.groupBy("session", "run").agg(F.count("*").alias("n")).groupBy("session").agg(F.count("*").alias("segments"), F.max("n").alias("longest"), F.sum("n").alias("rows"))
    spans = runs.future_spans(rows, horizon, F.col("ts")).groupBy("session").agg(F.count("*").alias("futures"), F.min("seconds").alias("least_seconds"), F.max("seconds").alias("most_seconds"))
    zero = runs.zero_paths(rows, horizon).groupBy("session").agg(F.avg(F.col("unchanged").cast("int")).alias("unchanged"))
    names = feature_names(depth)
    present = [i for i, n in enumerate(names) if n.endswith("_present")]
    ends = observed.groupBy("session").agg(
        F.avg(1 - sum((F.col("x")[i] for i in present), F.lit(0.0)) / len(present)).alias("absent"),
        *(f(F.col("x")[i]).alias(f"_{k}{i}") for i in range(len(names)) for k, f in (("lo", F.min), ("hi", F.max))),
    )
    constant = sum(((F.col(f"_lo{i}") == F.col(f"_hi{i}")).cast("int") for i in range(len(names))), F.lit(0))
    out = lengths
    for other in (spans, zero, ends.select("session", "absent", constant.cast("int").alias("constant"))):
        out = out.join(other, "session", "left")
    return out.withColumn("futures", F.coalesce("futures", F.lit(0)))


def duration_quantiles(observations: DataFrame, horizon: int, marks: tuple[float, ...] = (0.0, 0.5, 0.95, 1.0)) -> DataFrame:
    """what, q, value: exact quantiles of segment lengths (rows) and of future durations (seconds) over all sessions."""
    rows = written(as_ticks(written(observations.select(*_NARROW), "observed")), "ticks")
    lengths = rows.groupBy("session", "run").agg(F.count("*").alias("n"))
    spans = runs.future_spans(rows, horizon, F.col("ts"))
    found = [(what, q, v) for what, df, c in (("segment_rows", lengths, "n"), ("future_seconds", spans, "seconds")) for q, v in zip(marks, exact_quantiles(df, F.col(c), list(marks))[1], strict=True)]
    return observations.sparkSession.createDataFrame(found, "what string, q double, value double")


def corpus_problems(sessions: DataFrame, least: int = 7) -> DataFrame:
    """problem, n: fewer than `least` sessions, a file digest or a seed that two sessions share, more than one configuration.

    sessions: session, sha256, seed, config; one row a session.
    """
    counts = sessions.agg(
        F.count("*").alias("sessions"), (F.count("*") - F.countDistinct("sha256")).alias("digests"), (F.count("*") - F.countDistinct("seed")).alias("seeds"), F.countDistinct("config").alias("configs")
    )
    problems = F.array(
        F.when(F.col("sessions") < least, F.struct(F.lit("too few sessions").alias("problem"), F.col("sessions").alias("n"))),
        F.when(F.col("digests") > 0, F.struct(F.lit("shared digests").alias("problem"), F.col("digests").alias("n"))),
        F.when(F.col("seeds") > 0, F.struct(F.lit("shared seeds").alias("problem"), F.col("seeds").alias("n"))),
        F.when(F.col("configs") > 1, F.struct(F.lit("several configurations").alias("problem"), F.col("configs").alias("n"))),
    )
    return counts.select(F.explode(F.array_compact(problems)).alias("p")).select("p.*")


def refuse_broken(report: DataFrame, depth: int = DEPTH) -> None:
    """Raises if a session is empty or breaks an expectation."""
    names = NAMES
    bad = report.filter((F.col("rows") == 0) | reduce(lambda a, b: a | b, [F.col(n) > 0 for n in names])).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"session {r['session']}: " + ", ".join(n for n in names if r[n]) for r in bad))


def split_sessions(sessions: DataFrame, session: str, train: float = 0.70, validation: float = 0.15, least: int = 7) -> DataFrame:
    """Whole sessions in order: the first 70 % (rounded down) train, the next 15 % validate, the rest test.

    One row a session goes through the ordering, not their data.
    """
    n = sessions.select(session).distinct().count()
    if n < least:
        raise ValueError(f"{n} sessions; a split needs {least}")
    first, second = int(n * train + 1e-9), int(n * train + 1e-9) + int(n * validation + 1e-9)
    place = F.row_number().over(Window.orderBy(session)) - 1
    return sessions.select(session).distinct().withColumn("place", place).select(session, F.when(F.col("place") < first, "train").when(F.col("place") < second, "validation").otherwise("test").alias("split"))


def split_by_month(days: DataFrame, day: str, first: str, last_train: str, validation: str, test: str) -> DataFrame:
    """Splits by month (yyyy-MM); days before `first` and after `test` belong to none."""
    month = F.date_format(day, "yyyy-MM")
    split = F.when((month >= first) & (month <= last_train), "train").when(month == validation, "validation").when(month == test, "test")
    return days.withColumn("split", split).filter(F.col("split").isNotNull())


def split_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in both: none, for disjoint splits."""
    return a.intersect(b)


def store_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with their multiplicity."""
    left = a.exceptAll(b).withColumn("side", F.lit("left"))
    return left.unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def reconcile(listed: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with the side that lacks them, and those listed more than once."""
    a = listed.groupBy(*keys).agg(F.count("*").alias("listed"))
    b = found.groupBy(*keys).agg(F.count("*").alias("found"))
    both = a.join(b, keys, "full_outer").fillna(0, ["listed", "found"])
    problem = F.when(F.col("found") == 0, "missing").when(F.col("listed") == 0, "unexpected").when(F.col("listed") > 1, "duplicate")
    return both.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def build_report(df: DataFrame, day: Column, rows: Column) -> DataFrame:
    """By month and weekday (1 is Sunday): days, rows, extremes, median, share of all rows; month 'all' for every month.

    ratio: a day's mean rows over those of all days, so that of weekday 1 says how Sundays compare.
    """
    daily = df.groupBy(day.alias("day")).agg(F.sum(rows).alias("rows"))
    tagged = daily.withColumn("month", F.date_format("day", "yyyy-MM")).withColumn("weekday", F.dayofweek("day"))
    cube = tagged.rollup("month", "weekday").agg(F.count("*").alias("days"), F.sum("rows").alias("total"), F.min("rows").alias("least"), F.max("rows").alias("most"), F.avg("rows").alias("mean"), F.median("rows").alias("median"))
    all_rows = tagged.agg(F.sum("rows").alias("all"), F.avg("rows").alias("all_mean"))  # a row a day
    found = cube.crossJoin(all_rows)  # one row
    return found.select(F.coalesce("month", F.lit("all")).alias("month"), F.coalesce("weekday", F.lit(0)).alias("weekday"), "days", "total", "least", "most", "mean", "median", (100 * F.col("total") / F.col("all")).alias("share"), (F.col("mean") / F.col("all_mean")).alias("ratio"))


def file_summary(events: DataFrame, keys: list[str]) -> DataFrame:
    """What a log holds: records, actions, snapshots, first and last clock, identities."""
    action = [F.sum((F.col("action") == a).cast("int")).alias(f"n_{a.lower()}") for a in "ACMRTFN"]
    return events.groupBy(*keys).agg(F.count("*").alias("records"), *action, F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("order_id").alias("orders"))


def action_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("action").agg(F.count("*").alias("n"))


def endpoint_counts(pairs: DataFrame) -> DataFrame:
    """How often each session is an endpoint, and in how many pairs with itself."""
    own = (F.col("s1") == F.col("s2")).cast("int")
    both = pairs.select(F.col("s1").alias("session"), own.alias("own")).unionByName(pairs.select(F.col("s2").alias("session"), F.lit(0).alias("own")))
    return both.groupBy("session").agg(F.count("*").alias("endpoints"), F.sum("own").alias("same_session_pairs"))


def stream_coverage(pairs: DataFrame, distance: str = "d_raw") -> DataFrame:
    """One row: pairs, pairs within a session, sessions seen, least and most endpoints of a session, sum of distances."""
    ends = endpoint_counts(pairs).agg(F.count("*").alias("sessions"), F.min("endpoints").alias("least_endpoints"), F.max("endpoints").alias("most_endpoints"))
    total = pairs.agg(F.count("*").alias("pairs"), F.sum((F.col("s1") == F.col("s2")).cast("int")).alias("same_session_pairs"), F.sum(distance).alias("distance_sum"))
    return total.crossJoin(ends)  # one row beside one row


def totals(df: DataFrame, by: str, *amounts: str) -> DataFrame:
    """by, n and the sums of amounts (costs, bytes) of each group and, with a null group, of all."""
    return df.rollup(by).agg(F.count("*").alias("n"), *(F.sum(a).alias(a) for a in amounts))
