"""Order books from order events: replay in order, and the same states declaratively."""

from __future__ import annotations

import pickle
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import feature_row
from ledgerloom.schema import DEPTH, LEVELS

REPLAYED = f"session bigint, source_row bigint, ts bigint, segment bigint, initial boolean, mid double, bids {LEVELS}, asks {LEVELS}, n_bids int, n_asks int, before_mid double, before_ts bigint"
MUTATING = ("A", "C", "M", "R")
#: Rows between checks of the incremental levels against the orders.
CHECK_EVERY = 1 << 16


class ReplayError(ValueError):
    """An event log that cannot be replayed."""


class Side:
    """Prices of one side in order, with quantity and number of orders at each."""

    def __init__(self, bids: bool):
        self.bids, self.prices, self.levels = bids, [], {}

    def add(self, price: float, qty: float, orders: int) -> None:
        level = self.levels.get(price)
        if level is None:
            if orders < 0:
                raise ReplayError(f"an order leaves a level that isn't there: {price}")
            insort(self.prices, price)
            self.levels[price] = [qty, orders]
            return
        level[0] += qty
        level[1] += orders
        if level[1] < 0 or level[1] > 0 and level[0] < -1e-9:
            raise ReplayError(f"less than nothing is left at {price}")
        if level[1] == 0:
            del self.levels[price]
            self.prices.pop(bisect_left(self.prices, price))

    def best(self) -> float | None:
        return (self.prices[-1] if self.bids else self.prices[0]) if self.prices else None

    def top(self, depth: int) -> list[dict]:
        some = self.prices[: -depth - 1 : -1] if self.bids else self.prices[:depth]
        return [{"price": p, "qty": self.levels[p][0], "orders": self.levels[p][1]} for p in some]


class Timeline:
    """One session's replay.

    mode 'replay': events before the end of the initial snapshot, and events without a valid receive clock, aren't
    emitted; a clock that runs back is an error; a missing clock, a stop time reached, a one-sided or crossed book or a
    nonpositive mid break the run. mode 'extract' emits the snapshot too. need_clear: the log must begin with a clear.
    """

    def __init__(self, mode: str = "replay", need_clear: bool = False, stop_ns: int | None = None, depth: int = DEPTH, check_every: int = CHECK_EVERY):
        self.mode, self.need_clear, self.stop_ns, self.depth, self.check_every = mode, need_clear, stop_ns, depth, check_every
        self.orders: dict[int, tuple[str, float, float]] = {}
        self.sides = {"BUY": Side(True), "SELL": Side(False)}
        self.segment, self.fresh, self.clock, self.rows, self.started, self.open, self.stopped = 0, True, None, 0, False, False, False
        self.last = (None, None)

    def apply(self, action: str, side: str, price: float, size: float, order_id: int) -> None:
        if action not in MUTATING:
            return
        if action == "R":
            self.orders.clear()
            self.sides = {"BUY": Side(True), "SELL": Side(False)}
            self.brk()
            return
        old = self.orders.pop(order_id, None)
        if old:
            self.sides[old[0]].add(old[1], -old[2], -1)
        if action != "C":
            self.orders[order_id] = (side, price, size)
            self.sides[side].add(price, size, 1)

    def brk(self) -> None:
        self.segment, self.fresh, self.last = self.segment + 1, True, (None, None)

    def check(self) -> None:
        """The incremental levels are those that the orders make."""
        want: dict = {}
        for side, price, size in self.orders.values():
            level = want.setdefault((side, price), [0.0, 0])
            level[0] += size
            level[1] += 1
        have = {(s, p): level for s, side in self.sides.items() for p, level in side.levels.items()}
        if want.keys() != have.keys() or any(abs(want[k][0] - have[k][0]) > 1e-6 or want[k][1] != have[k][1] for k in want):
            raise ReplayError("levels differ from the orders")

    def step(self, row) -> dict | None:
        """Applies (source_row, ts, action, side, price, size, order_id, is_last, is_snapshot); an observation, or none."""
        source_row, ts, action, side, price, size, order_id, is_last, is_snapshot = row
        if self.stopped:
            return None
        if self.need_clear and not self.started and not self.orders and action != "R":
            if action in MUTATING and not is_snapshot:
                raise ReplayError("a live order event before the initial snapshot")
            raise ReplayError("the log must begin with a clear")
        self.started = True
        if ts is not None:
            if self.clock is not None and ts < self.clock:
                raise ReplayError("the receive clock runs back")
            self.clock = ts
        self.apply(action, side, price, size, order_id)
        self.open = not is_last
        if not is_last:
            return None
        self.rows += 1
        if self.rows % self.check_every == 0:
            self.check()
        if is_snapshot and self.mode == "replay":
            return None
        if ts is None:
            self.brk()
            return None
        if self.stop_ns is not None and ts >= self.stop_ns:
            self.stopped = True
            return None
        bid, ask = self.sides["BUY"].best(), self.sides["SELL"].best()
        if bid is None or ask is None or bid > ask or bid + ask <= 0:
            self.brk()
            return None
        first, self.fresh = self.fresh, False
        bids, asks = self.sides["BUY"], self.sides["SELL"]
        before, self.last = self.last, ((bid + ask) / 2, ts)
        return {
            "source_row": source_row, "ts": ts, "segment": self.segment, "initial": first, "mid": (bid + ask) / 2,
            "bids": bids.top(self.depth), "asks": asks.top(self.depth), "n_bids": len(bids.prices), "n_asks": len(asks.prices),
            "before_mid": before[0], "before_ts": before[1],
        }

    def finish(self) -> None:
        if self.open and not self.stopped:
            raise ReplayError("the log ends inside an event")


_INPUT = ["source_row", "ts", "action", "side", "price", "size", "order_id", "is_last", "is_snapshot"]


_COLUMNS = ["session", "source_row", "ts", "segment", "initial", "mid", "bids", "asks", "n_bids", "n_asks", "before_mid", "before_ts"]


def frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    out["before_mid"] = out["before_mid"].astype("float64")
    out["before_ts"] = pd.array([r["before_ts"] for r in rows], "Int64")  # never by way of a float
    return out


def replay(events: DataFrame, mode: str = "replay", need_clear: bool = False, stop_ns: int | None = None, depth: int = DEPTH, strict_end: bool = False) -> DataFrame:
    """Observations of every session, batch after batch: a task holds one book, never a session's rows."""
    if "is_snapshot" not in events.columns:
        events = events.withColumn("is_snapshot", F.lit(False))

    def run(batches):
        session, line = None, None
        for pdf in batches:
            out = []
            for key, *row in pdf[["session", *_INPUT]].astype(object).where(pdf[["session", *_INPUT]].notna(), None).itertuples(index=False, name=None):
                if line is None or key != session:
                    if line is not None and strict_end:
                        line.finish()
                    session, line = key, Timeline(mode, need_clear, stop_ns, depth)
                found = line.step(row)
                if found:
                    out.append({"session": key, **found})
            yield frame(out)
        if line is not None and strict_end:
            line.finish()

    dealt = events.select("session", *_INPUT).repartition("session").sortWithinPartitions("session", "source_row")
    return dealt.mapInPandas(run, REPLAYED)


def order_intervals(events: DataFrame) -> DataFrame:
    """Each order's states with the source rows [source_row, until) during which they hold."""
    w = Window.partitionBy("session", "order_id").orderBy("source_row")
    rows = events.filter(F.col("action").isin("A", "C", "M")).withColumn("until", F.coalesce(F.lead("source_row").over(w), F.lit(2**62)))
    return rows.filter(F.col("action") != "C").select("session", "order_id", "side", "price", "size", "source_row", "until")


def book_at(events: DataFrame, at: int | None = None) -> DataFrame:
    """The orders alive after source row `at` (or the last): each order's latest state, by one aggregation."""
    rows = events.filter(F.col("action").isin("A", "C", "M"))
    rows = rows if at is None else rows.filter(F.col("source_row") <= at)
    latest = rows.groupBy("session", "order_id").agg(F.max_by(F.struct("action", "side", "price", "size"), "source_row").alias("s"))
    return latest.select("session", "order_id", "s.*").filter(F.col("action") != "C").drop("action")


def price_levels(orders: DataFrame) -> DataFrame:
    return orders.groupBy("session", "side", "price").agg(F.sum("size").alias("qty"), F.count("*").alias("orders"))


def top_levels(levels: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The best `depth` levels of each side, level 1 first."""
    best = F.when(F.col("side") == "BUY", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy("session", "side").orderBy("_best")
    return levels.withColumn("_best", best).withColumn("level", F.row_number().over(w)).filter(F.col("level") <= depth).drop("_best")


def book_summary(levels: DataFrame) -> DataFrame:
    """Best prices, spread and total sizes of each session's book, prices as decimals."""
    bid, ask = F.col("side") == "BUY", F.col("side") == "SELL"
    found = levels.groupBy("session").agg(
        F.max(F.when(bid, F.col("price"))).alias("best_bid"),
        F.min(F.when(ask, F.col("price"))).alias("best_ask"),
        F.sum(F.when(bid, F.col("qty"))).alias("bid_qty"),
        F.sum(F.when(ask, F.col("qty"))).alias("ask_qty"),
        F.count("*").alias("n_levels"),
    )
    return found.withColumn("spread", (F.col("best_ask") - F.col("best_bid")).cast("decimal(18,9)")).withColumn("best_bid", F.col("best_bid").cast("decimal(18,9)")).withColumn("best_ask", F.col("best_ask").cast("decimal(18,9)"))


def observations(replayed: DataFrame, tick: float = 0.25, clock: str = "simulation", depth: int = DEPTH) -> DataFrame:
    """The replay with its feature arrays; the row before in the segment comes with each row, so nothing is shuffled."""
    x = feature_row(F.col("bids"), F.col("asks"), F.col("mid"), tick, F.col("ts"), F.col("before_mid"), F.col("before_ts"), depth, clock)
    return replayed.withColumn("x", x)


def replay_metrics(events: DataFrame, observed: DataFrame) -> DataFrame:
    """One row a session: records, completed events, actions, emitted rows, segments, most levels of a side, clock range."""
    action = [F.sum((F.col("action") == a).cast("int")).alias(f"n_{a.lower()}") for a in "ACMR"]
    read = events.groupBy("session").agg(F.count("*").alias("records"), F.sum(F.col("is_last").cast("int")).alias("completed"), *action)
    out = observed.groupBy("session").agg(
        F.count("*").alias("rows"), F.countDistinct("segment").alias("segments"), F.max(F.greatest("n_bids", "n_asks")).alias("most_levels"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return read.join(out, "session", "left").fillna(0, ["rows", "segments", "most_levels"])


def dump(line: Timeline) -> bytes:
    return pickle.dumps(line)


def load(state: bytes) -> Timeline:
    return pickle.loads(state)
