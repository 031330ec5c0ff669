"""Book replay and pair batches as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.functions.scalars import future_path_rms, plain_count
from ledgerloom.operators import book, runs
from ledgerloom.operators.pairs import PairIndex, endpoints, materialise, unrank_pairs
from ledgerloom.operators.seeded import SeededOrder, stretch
from ledgerloom.sources.store import freeze


def replay_stream(events: DataFrame, depth: int = book.DEPTH) -> DataFrame:
    """Observations of a stream of order events; the open books are the state. A batch's rows are ordered by source row.

    Late rows aren't tolerated: a receive clock that runs back fails the query, as in the batch replay.
    """
    if "is_snapshot" not in events.columns:
        events = events.withColumn("is_snapshot", F.lit(False))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line = book.load(state.get[0]) if state.exists else book.Timeline(depth=depth)
        rows = pd.concat(list(frames)).sort_values("source_row")
        rows = rows[book._INPUT].astype(object).where(rows[book._INPUT].notna(), None)
        out = [{"session": key[0], **found} for row in rows.itertuples(index=False, name=None) if (found := line.step(row))]
        state.update((book.dump(line),))
        yield book.frame(out)

    return events.select("session", *book._INPUT).groupBy("session").applyInPandasWithState(step, book.REPLAYED, "line binary", "append", GroupStateTimeout.NoTimeout)


class PairStream:
    """Queues of pair ids in a seeded order, with a state from which another process goes on.

    The counter moves only when a queue has been delivered, so a failed batch skips no pair. The last queue holds what is
    left, later ones nothing.
    """

    def __init__(self, spark: SparkSession, order: SeededOrder, queue_pairs: int = 16_384, batch_pairs: int = 32, counter: int = 0):
        if not 1 <= batch_pairs <= queue_pairs:
            raise ValueError("batch_pairs must lie in 1 .. queue_pairs")
        if not 0 <= counter <= order.total:
            raise ValueError("the counter must lie in 0 .. total")
        self.spark, self.order, self.queue_pairs, self.batch_pairs, self.counter = spark, order, queue_pairs, batch_pairs, counter

    @property
    def _stop(self) -> int:
        return min(self.counter + self.queue_pairs, self.order.total)

    def next_queue(self) -> DataFrame:
        """(place, pair_id, batch) of the next queue; call delivered() once it has been used."""
        if self.counter >= self.order.total:
            raise StopIteration
        return stretch(self.spark, self.order, self.counter, self._stop).withColumn("batch", F.floor((F.col("place") - self.counter) / self.batch_pairs))

    def episodes(self, queue: DataFrame, index: PairIndex, ticks: DataFrame, value: str, history: int, horizon: int) -> DataFrame:
        """The queue with both episodes of each pair: s1, a1, s2, a2, histories x1, x2, futures y1, y2, and d_raw."""
        chosen = unrank_pairs(queue, index).join(queue, "pair_id")
        futures = runs.futures(ticks, horizon, history).select("session", "anchor", "y")
        both = runs.histories(ticks, endpoints(chosen), value, history).join(futures, ["session", "anchor"])
        met = materialise(chosen, both.withColumn("episode", F.struct("x", "y")), "episode")
        return met.select(
            "pair_id", "place", "batch", "s1", "a1", "s2", "a2", F.col("left.x").alias("x1"), F.col("right.x").alias("x2"), F.col("left.y").alias("y1"), F.col("right.y").alias("y2"),
            future_path_rms(F.col("left.y"), F.col("right.y")).alias("d_raw"),
        )

    def delivered(self) -> None:
        self.counter = self._stop

    def state(self) -> dict:
        return self.order.state(self.counter) | {"queue_pairs": self.queue_pairs, "batch_pairs": self.batch_pairs}

    @classmethod
    def restore(cls, spark: SparkSession, state: dict, queue_pairs: int, batch_pairs: int, **expected) -> PairStream:
        if (state["queue_pairs"], state["batch_pairs"]) != (queue_pairs, batch_pairs):
            raise ValueError("queue and batch sizes must be those of the saved state")
        order, counter = SeededOrder.restore(state, **expected)
        return cls(spark, order, queue_pairs, batch_pairs, counter)


def validation_sample(spark: SparkSession, order: SeededOrder, pairs: int, path: str) -> DataFrame:
    """(place, pair_id) of the first pairs of a held-out split's order, frozen as a document; another one there is an error."""
    ids = order.numbers(np.arange(min(plain_count(pairs, "pairs"), order.total)))
    kept = freeze(spark, path, order.state(0) | {"pair_count": len(ids), "pair_ids": ids.tolist()})
    return spark.createDataFrame(list(enumerate(kept["pair_ids"])), "place bigint, pair_id bigint")
