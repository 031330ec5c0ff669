"""A seeded order of the numbers below a total, for whole arrays of places at once.

A number is two halves of equal width; in each round one half takes in a keyed digest of the other, in turn. So every
array of places maps to distinct numbers, without a table of those seen. Results that aren't below the total go through
again until they are.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MOST = 2**63 - 1

# What names the order, keys its rounds and digests a half; a saved place means the same number by them.
VERSION = "feistel8-blake2b-v1"
ROUNDS = 8
HALF = np.dtype("<u8")


@dataclass(frozen=True)
class SeededOrder:
    """The order of [0, total) that belongs to a corpus, one of its splits and a seed."""

    total: int
    corpus: str
    split: str
    seed: int
    keys: tuple[bytes, ...] = field(init=False, repr=False)

    def __post_init__(self):
        if not 0 < self.total <= MOST:
            raise ValueError("the number of pairs must fit 1 .. 2**63 - 1")
        if isinstance(self.seed, bool) or not isinstance(self.seed, int) or self.seed < 0:
            raise ValueError("the seed must be a whole number from 0 on")
        names = (":".join(map(str, (VERSION, self.corpus, self.split, self.seed, r))) for r in range(ROUNDS))
        object.__setattr__(self, "keys", tuple(hashlib.sha256(n.encode()).digest() for n in names))

    @property
    def width(self) -> int:
        """Bits of a half: the fewest with which two halves hold every number below the total."""
        return max(1, -(-(self.total - 1).bit_length() // 2))

    def _digests(self, key: bytes, halves: np.ndarray) -> np.ndarray:
        """The digest of each half; those that occur often are digested once."""
        distinct, where = np.unique(halves, return_inverse=True)
        raw = distinct.astype(HALF).tobytes()
        made = b"".join(hashlib.blake2b(raw[i : i + 8], key=key, digest_size=8).digest() for i in range(0, len(raw), 8))
        return np.frombuffer(made, HALF)[where]

    def _scrambled(self, numbers: np.ndarray) -> np.ndarray:
        width, low = np.uint64(self.width), np.uint64((1 << self.width) - 1)
        halves = [numbers >> width, numbers & low]
        for turn, key in enumerate(self.keys):
            halves[turn % 2] ^= self._digests(key, halves[1 - turn % 2]) & low
        return halves[0] << width | halves[1]

    def numbers(self, places: np.ndarray) -> np.ndarray:
        """The number at each place."""
        places = np.asarray(places, np.int64)
        if len(places) and not 0 <= places.min() <= places.max() < self.total:
            raise IndexError("a place beyond the order")
        out = self._scrambled(places.astype(np.uint64))
        while len(over := np.flatnonzero(out >= np.uint64(self.total))):
            out[over] = self._scrambled(out[over])
        return out.astype(np.int64)

    def state(self, counter: int) -> dict:
        return {"version": VERSION, "corpus": self.corpus, "split": self.split, "total": self.total, "seed": self.seed, "counter": counter}

    @classmethod
    def restore(cls, state: dict, **expected) -> tuple[SeededOrder, int]:
        """(order, counter) of a saved state; refuses one of another version, corpus, split or total than expected."""
        for k, v in ({"version": VERSION} | expected).items():
            if state.get(k) != v:
                raise ValueError(f"the state's {k} is {state.get(k)!r}, not {v!r}")
        return cls(state["total"], state["corpus"], state["split"], state["seed"]), state["counter"]


def stretch(spark: SparkSession, order: SeededOrder, start: int, stop: int) -> DataFrame:
    """(place, pair_id) of the places from start up to stop; each task orders its own batches."""
    shared = spark.sparkContext.broadcast(order)

    def walk(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.numbers(batch.column(0).to_numpy()))], names=["place", "pair_id"])

    return spark.range(start, stop).mapInArrow(walk, "place bigint, pair_id bigint")
