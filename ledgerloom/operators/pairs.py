"""The universe of eligible episode pairs: counts in closed form, ranks both ways, a seeded order, bounded joins.

Pairs are never enumerated: a session's within-pairs (gap rows apart at least) come first, by the earlier anchor, then its
cross pairs with every later session; sessions follow each other by id.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.seeded import MOST


def _triangle(n: Column) -> Column:
    n = F.greatest(n, F.lit(0)).cast("decimal(38,0)")
    return (n * (n + 1) / 2).cast("decimal(38,0)")


def range_pairs(a: Column, b: Column, c: Column, d: Column, gap: int) -> Column:
    """How many x in [a, b) and y in [c, d) have y - x >= gap."""
    g = F.lit(gap)
    return _triangle(d - g - a) - _triangle(d - g - b) - _triangle(c - g - a) + _triangle(c - g - b)


def within_pairs(ranges: DataFrame, gap: int) -> DataFrame:
    """session, within_pairs. All pairs of anchors less those nearer than the gap.

    Only ranges that begin less than `gap` after another's end hold near pairs across ranges; a self-join in blocks of
    `gap` rows finds them, so distant ranges never meet.
    """
    n = F.col("stop") - F.col("start")
    whole = ranges.groupBy("session").agg(
        F.sum(n.cast("decimal(38,0)")).alias("n"),
        F.sum(range_pairs(F.col("start"), F.col("stop"), F.col("start"), F.col("stop"), 1) - range_pairs(F.col("start"), F.col("stop"), F.col("start"), F.col("stop"), gap)).alias("near_own"),
    )
    ends = ranges.select("session", F.col("start").alias("a"), F.col("stop").alias("b")).withColumn("block", F.explode(F.sequence(F.call_function("div", F.col("b") - 1, F.lit(gap)), F.call_function("div", F.col("b") - 1, F.lit(gap)) + 1)))
    begins = ranges.select("session", F.col("start").alias("c"), F.col("stop").alias("d")).withColumn("block", F.call_function("div", F.col("c"), F.lit(gap)))
    near = ends.join(begins, ["session", "block"]).filter((F.col("c") >= F.col("b")) & (F.col("c") - F.col("b") + 1 < gap))
    sides = [F.col(x) for x in "abcd"]
    near = near.groupBy("session").agg(F.sum(range_pairs(*sides, 1) - range_pairs(*sides, gap)).alias("near_cross"))
    total = whole.join(near, "session", "left")
    count = total["n"] * (total["n"] - 1) / 2 - F.col("near_own") - F.coalesce(F.col("near_cross"), F.lit(0))
    return total.select("session", F.col("n").cast("bigint").alias("anchors"), count.cast("bigint").alias("within_pairs"))


def pair_counts(ranges: DataFrame, gap: int) -> DataFrame:
    """session, anchors, within_pairs, cross_pairs (with later sessions); one row a session, so its window is small."""
    found = within_pairs(ranges, gap)
    later = F.coalesce(F.sum(F.col("anchors").cast("decimal(38,0)")).over(Window.orderBy(F.desc("session")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("cross_pairs", (F.col("anchors") * later).cast("bigint"))


def eligible_pairs(left: DataFrame, gap: int, right: DataFrame | None = None) -> DataFrame:
    """(session, a, b) with b - a >= gap, for bounded anchor sets (a sample): an equi-join on the session."""
    right = left if right is None else right
    return left.select("session", F.col("anchor").alias("a")).join(right.select("session", F.col("anchor").alias("b")), "session").filter(F.col("b") - F.col("a") >= gap)


#: Run ranges that the driver collects and sends to every task; beyond, each session's are met in one task.
MOST_RANGES = 2_000_000


@dataclass
class PairIndex:
    """Ranks of pairs, for whole arrays. ranges: {session: [(start, stop), ...]}, one entry per run.

    A session's anchors are numbered on from those of the sessions before it. Its pairs are counted in stretches of
    anchors over which the number of later partners is constant or falls by one an anchor.
    """

    ranges: dict[int | str, list[tuple[int, int]]]
    gap: int
    sessions: list = field(init=False)
    total: int = field(init=False)

    def __post_init__(self):
        self.sessions = sorted(self.ranges)
        place = {s: k for k, s in enumerate(self.sessions)}
        runs = np.array([(place[s], a, b) for s in self.sessions for a, b in sorted(self.ranges[s])], np.int64).reshape(-1, 3)
        self._session, self._start, stop = runs.T
        self._first = np.concatenate([[0], np.cumsum(stop - self._start)])  # number of each run's first anchor
        #: rows of one session lie apart from those of the next by so many
        self._apart = int(stop.max(initial=0)) + self.gap + 2
        self._key = self._session * self._apart + self._start
        edges = np.searchsorted(self._session, np.arange(len(self.sessions) + 1))
        self._begin = self._first[edges]  # number of each session's first anchor, and of none
        self._later = self._begin[-1] - self._begin[1:]
        marks = [np.unique(np.concatenate([self._first[edges[k] : edges[k + 1] + 1], *(self._number(np.full(edges[k + 1] - edges[k], k), x[edges[k] : edges[k + 1]] - self.gap) for x in (self._start, stop))])) for k in range(len(self.sessions))]
        at = np.concatenate([m[:-1] for m in marks] or [np.zeros(0, np.int64)])
        size = np.concatenate([np.diff(m) for m in marks] or [np.zeros(0, np.int64)])
        self._at, self._most = at, self._partners(at)
        self._fall = np.where(size > 1, self._most - self._partners(at + size - 1) > 0, False).astype(np.int64)
        pairs = [int(m) * int(n) - int(f) * int(n) * (int(n) - 1) // 2 for m, n, f in zip(self._most, size, self._fall, strict=True)]
        # where each stretch and each session's cross pairs begin, in Python's whole numbers until the total is known to fit
        counts = np.diff(self._begin)
        self._offset, before, own = [], [], np.searchsorted(self._at, self._begin)
        total = 0
        self._cross = []
        for k in range(len(self.sessions)):
            self._offset.append(total)
            for n in pairs[own[k] : own[k + 1]]:
                before.append(total)
                total += n
            self._cross.append(total)
            total += int(counts[k]) * int(self._later[k])
        self.total = total
        if total > MOST:
            raise ValueError("more pairs than a 64-bit number can count")
        self._offset, self._cross, self._before = (np.array(x, np.int64) for x in (self._offset, self._cross, before))

    def _number(self, session: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many anchors lie before `row` of the session, those of earlier sessions among them."""
        k = np.searchsorted(self._key, session * self._apart + np.clip(row, -1, self._apart - 2), "right") - 1
        own = (k >= 0) & (self._session[np.maximum(k, 0)] == session)
        inside = np.minimum(self._first[k + 1], self._first[np.maximum(k, 0)] + row - self._start[np.maximum(k, 0)])
        return np.where(own, inside, self._first[np.searchsorted(self._session, session)])

    def _anchor(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the session, row) of each numbered anchor."""
        k = np.searchsorted(self._first, number, "right") - 1
        return self._session[k], self._start[k] + number - self._first[k]

    def _partners(self, number: np.ndarray) -> np.ndarray:
        """How many anchors of its session lie a gap or more after each numbered anchor."""
        if not len(number):
            return number
        session, row = self._anchor(number)
        return self._begin[session + 1] - self._number(session, row + self.gap)

    def _pairs_in(self, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Pairs of the first n anchors of stretch k."""
        return self._most[k] * n - self._fall[k] * (n * (n - 1) // 2)

    def ranks(self, s1, a1, s2, a2) -> np.ndarray:
        """The number of each pair, given as session places (in `sessions`) and rows, in either order."""
        s1, a1, s2, a2 = (np.asarray(x, np.int64) for x in (s1, a1, s2, a2))
        turned = (s1 > s2) | (s1 == s2) & (a1 > a2)
        s1, s2, a1, a2 = np.where(turned, s2, s1), np.where(turned, s1, s2), np.where(turned, a2, a1), np.where(turned, a1, a2)
        x, y, far = self._number(s1, a1), self._number(s2, a2), self._number(s1, a1 + self.gap)
        if ((s1 == s2) & (a2 - a1 < self.gap)).any() or any((self._number(s, a + 1) == n).any() for s, a, n in ((s1, a1, x), (s2, a2, y))):
            raise ValueError("not an eligible pair")
        k = np.maximum(np.searchsorted(self._at, x, "right") - 1, 0)
        within = self._before[k] + self._pairs_in(k, x - self._at[k]) + y - far
        return np.where(s1 == s2, within, self._cross[s1] + (x - self._begin[s1]) * self._later[s1] + y - self._begin[s1 + 1])

    def pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(s1, a1, s2, a2) of each number, sessions as places in `sessions`."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ids, ids, ids, ids
        if not 0 <= ids.min() <= ids.max() < self.total:
            raise ValueError("no such pair")
        session = np.searchsorted(self._offset, ids, "right") - 1
        cross = ids >= self._cross[session]
        rest = ids - self._cross[session]
        later = np.maximum(self._later[session], 1)
        x, y = self._begin[session] + rest // later, self._begin[session + 1] + rest % later
        at = np.flatnonzero(~cross)
        if len(at):
            k = np.searchsorted(self._before, ids[at], "right") - 1
            rest = ids[at] - self._before[k]
            most, fall = self._most[k], self._fall[k] == 1
            n = rest // np.maximum(most, 1)
            wide = 2.0 * most + 1
            guess = ((wide - np.sqrt(np.maximum(wide * wide - 8.0 * rest, 0))) / 2).astype(np.int64)
            n = np.where(fall, np.clip(guess, 0, np.maximum(most - 1, 0)), n)
            while (over := self._pairs_in(k, n) > rest).any():
                n -= over
            while (under := (self._pairs_in(k, n + 1) <= rest) & (n + 1 < np.where(fall, most, MOST))).any():
                n += under
            x[at] = self._at[k] + n
            y[at] = self._begin[session[at] + 1] - (most - self._fall[k] * n) + rest - self._pairs_in(k, n)
        return *self._anchor(x), *self._anchor(y)

    def rank(self, s1, a1: int, s2, a2: int) -> int:
        return int(self.ranks([self.sessions.index(s1)], [a1], [self.sessions.index(s2)], [a2])[0])

    def unrank(self, pair_id: int):
        s1, a1, s2, a2 = (int(x[0]) for x in self.pairs([pair_id]))
        return self.sessions[s1], a1, self.sessions[s2], a2

    @classmethod
    def of(cls, ranges: DataFrame, gap: int) -> PairIndex:
        """Collects the run ranges (one row a run, MOST_RANGES at most) and builds the index on the driver."""
        rows = ranges.select("session", "start", "stop").limit(MOST_RANGES + 1).collect()
        if len(rows) > MOST_RANGES:
            raise ValueError(f"more than {MOST_RANGES} runs; use unrank_by_session")
        out: dict = {}
        for r in rows:
            out.setdefault(r["session"], []).append((r["start"], r["stop"]))
        return cls(out, gap)


_PAIRS = "pair_id bigint, s1 bigint, a1 bigint, s2 bigint, a2 bigint"


def unrank_pairs(ids: DataFrame, index: PairIndex, column: str = "pair_id") -> DataFrame:
    """pair_id, s1, a1, s2, a2 of each pair id, by a bounded index that every task gets."""
    shared = ids.sparkSession.sparkContext.broadcast(index)

    def look(batches):
        sessions = np.array(shared.value.sessions)
        for batch in batches:
            s1, a1, s2, a2 = shared.value.pairs(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (sessions[s1], a1, sessions[s2], a2))], names=["pair_id", "s1", "a1", "s2", "a2"])

    return ids.select(F.col(column).alias("pair_id")).mapInArrow(look, _PAIRS)


def rank_pairs(pairs: DataFrame, index: PairIndex) -> DataFrame:
    """pairs (s1, a1, s2, a2, ...) with `rank`, their number."""
    shared = pairs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("bigint")
    def look(s1: pd.Series, a1: pd.Series, s2: pd.Series, a2: pd.Series) -> pd.Series:
        place = {s: k for k, s in enumerate(shared.value.sessions)}
        return pd.Series(shared.value.ranks(s1.map(place), a1, s2.map(place), a2))

    return pairs.withColumn("rank", look("s1", "a1", "s2", "a2"))


def unrank_by_session(ids: DataFrame, ranges: DataFrame, gap: int) -> DataFrame:
    """unrank_pairs() for more runs than a driver holds: ids meet the runs of their sessions, a session's in one task.

    The driver collects one row a session. A cross pair's later anchor is looked up in a second step.
    """
    spark = ids.sparkSession
    counts = pair_counts(ranges, gap).orderBy("session").collect()
    n = np.array([r["anchors"] for r in counts], np.int64)
    begin = np.concatenate([[0], np.cumsum(n)])
    sizes = [int(r["within_pairs"]) + int(r["cross_pairs"]) for r in counts]
    offset = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    shared = spark.sparkContext.broadcast((np.array([r["session"] for r in counts]), begin, offset, np.array([r["within_pairs"] for r in counts], np.int64)))

    def route(batches):
        """pair_id; its first session with the number of the pair or the place of the anchor there; the same of a second one."""
        session, begin, offset, within = shared.value
        for batch in batches:
            x = batch.column(0).to_numpy()
            if len(x) and not 0 <= x.min() <= x.max() < offset[-1]:
                raise ValueError("no such pair")
            k = np.searchsorted(offset, x, "right") - 1
            rest = x - offset[k] - within[k]
            cross, later = rest >= 0, np.maximum(begin[-1] - begin[k + 1], 1)
            number = begin[k + 1] + rest % later
            other = np.minimum(np.searchsorted(begin, number, "right") - 1, len(session) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(session[k]), pa.array(np.where(cross, rest // later, rest + within[k])), pa.array(session[other], mask=~cross), pa.array(number - begin[other], mask=~cross)],
                names=["pair_id", "s1", "p1", "s2", "p2"],
            )

    def look(key: tuple, some: pa.Table, own: pa.Table) -> pa.Table:
        """Rows for a session's own pairs, and for the anchors that cross pairs have there (side 1 or 2)."""
        out = {c: [] for c in ("pair_id", "side", "s", "a", "b")}
        if len(some):
            index = PairIndex({key[0].as_py(): list(zip(own["start_"].to_pylist(), own["stop_"].to_pylist(), strict=True))}, gap)
            side, place = some["side"].to_numpy(), some["p"].to_numpy()
            a, b = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
            _, a[side == 0], _, b[side == 0] = index.pairs(place[side == 0])
            a[side > 0] = index._anchor(place[side > 0])[1]
            return pa.table({"pair_id": some["pair_id"], "side": some["side"], "s": some["s"], "a": pa.array(a), "b": pa.array(b)})
        return pa.table({c: pa.array([], pa.int32() if c == "side" else pa.int64()) for c in out})

    sent = ids.select("pair_id").distinct().mapInArrow(route, "pair_id bigint, s1 bigint, p1 bigint, s2 bigint, p2 bigint")
    sides = F.when(F.col("s2").isNull(), F.array(F.struct(F.lit(0).alias("side"), F.col("s1").alias("s"), F.col("p1").alias("p")))).otherwise(
        F.array(F.struct(F.lit(1).alias("side"), F.col("s1").alias("s"), F.col("p1").alias("p")), F.struct(F.lit(2).alias("side"), F.col("s2").alias("s"), F.col("p2").alias("p")))
    )
    asked = sent.select("pair_id", F.explode(sides).alias("x")).select("pair_id", "x.side", "x.s", "x.p")
    runs = ranges.select(F.col("session").alias("s_"), F.col("start").alias("start_"), F.col("stop").alias("stop_"))
    found = asked.groupBy("s").cogroup(runs.groupBy("s_")).applyInArrow(look, "pair_id bigint, side int, s bigint, a bigint, b bigint")
    both = found.groupBy("pair_id").agg(
        F.max(F.when(F.col("side") < 2, F.col("s"))).alias("s1"), F.max(F.when(F.col("side") < 2, F.col("a"))).alias("a1"),
        F.max(F.when(F.col("side") != 1, F.col("s"))).alias("s2"), F.max(F.when(F.col("side") == 0, F.col("b")).when(F.col("side") == 2, F.col("a"))).alias("a2"),
    )
    return ids.select("pair_id").join(both, "pair_id")


def fingerprint(document) -> str:
    """sha256 over canonical JSON."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def endpoints(pairs: DataFrame) -> DataFrame:
    """Distinct (session, anchor) that the pairs use."""
    return pairs.select(F.col("s1").alias("session"), F.col("a1").alias("anchor")).unionByName(pairs.select(F.col("s2").alias("session"), F.col("a2").alias("anchor"))).distinct()


def materialise(pairs: DataFrame, episodes: DataFrame, value: str = "y") -> DataFrame:
    """The pairs with both sides' values, by two equi-joins."""
    left = episodes.select(F.col("session").alias("s1"), F.col("anchor").alias("a1"), F.col(value).alias("left"))
    right = episodes.select(F.col("session").alias("s2"), F.col("anchor").alias("a2"), F.col(value).alias("right"))
    return pairs.join(left, ["s1", "a1"]).join(right, ["s2", "a2"])
