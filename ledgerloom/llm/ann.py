"""Nearest neighbours by a forest of hash-prefix trees.

A tree is a sorted array of long hash strings (signs of random projections of the centred vectors). A query descends in
every tree to the longest prefix that any row shares with it, and all trees then ascend together, a level at a time,
until they hold enough candidates; these are ranked by their exact distance. The index is cut into shards of rows, each
with its part of every tree; the level at which a query stops is found over all shards, then each shard ranks its own.
Queries meet shards in blocks of QUERIES, so no task holds more than one shard and one block.

How many candidates are enough is fitted on a bounded sample (SAMPLE rows, PROBES queries): the least share of the rows
that finds TARGET of the true neighbours there. Every row is indexed.

Vectors that are null, zero, hold null or non-finite components, or have another than the most frequent length take no
part; neither do rows with a null id. Equal vectors are indexed once, with as many of their smallest ids as any query
can return, so copies neither crowd a bucket nor each other out. Ties go to the smaller id. Repeated ids count once, with
the least of their vectors, as a query too. An empty table, or one without queries, gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

TREES, BITS, SEED = 64, 48, 20240611
SHARD_ROWS, QUERIES = 8192, 4096
SAMPLE, PROBES, TARGET = 8192, 128, 0.95
SHARES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 1.0)


class Forest:
    """Sorted hash strings of some rows, for every tree."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray):
        self.vectors, self.centre = vectors, centre
        keys = hash_strings(vectors, centre)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, 1)

    def ranges(self, strings: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query: where the rows lie that share the first `level` bits; strings [trees, queries]."""
        rest = (BITS - level).astype(np.uint64)
        low = (strings >> rest) << rest
        high = low | ((np.uint64(1) << rest) - np.uint64(1))
        lo = np.stack([np.searchsorted(k, x, "left") for k, x in zip(self.keys, low, strict=True)])
        hi = np.stack([np.searchsorted(k, x, "right") for k, x in zip(self.keys, high, strict=True)])
        return lo, hi

    def counts(self, strings: np.ndarray) -> np.ndarray:
        """[queries, BITS + 1]: rows, over all trees, that share at least so many bits with a query."""
        q = strings.shape[1]
        out = np.zeros((q, BITS + 1), np.int64)
        for level in range(BITS + 1):
            lo, hi = self.ranges(strings, np.full(q, level))
            out[:, level] = (hi - lo).sum(0)
            if not out[:, level].any():  # no query's longest match goes deeper
                break
        return out

    def candidates(self, strings: np.ndarray, level: np.ndarray):
        """Each query's rows that share its `level` bits in some tree."""
        lo, hi = self.ranges(strings, level)
        for k in range(strings.shape[1]):
            mask = np.zeros(len(self.vectors), bool)
            for tree in range(len(self.keys)):
                mask[self.order[tree, lo[tree, k] : hi[tree, k]]] = True
            yield np.flatnonzero(mask)


def hash_strings(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """[trees, rows] strings of BITS bits as numbers."""
    planes = np.random.default_rng(SEED).normal(size=(TREES, len(centre), BITS))
    out = np.zeros((TREES, len(vectors)), np.uint64)
    weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    for tree in range(TREES):
        out[tree] = (((vectors - centre) @ planes[tree]) > 0) @ weights
    return out


def stop_level(counts: np.ndarray, enough: float) -> np.ndarray:
    """The deepest level at which the trees together hold enough rows; 0 (all rows) if none does."""
    return np.where(counts >= enough, np.arange(BITS + 1), 0).max(1)


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(1))


def fit_share(sample: np.ndarray, k: int, centre: np.ndarray) -> float:
    """The least share of SHARES whose candidates hold TARGET of the k nearest, for PROBES queries of the sample."""
    if len(sample) <= 10 * k:
        return 1.0
    rng = np.random.default_rng(SEED)
    probe = rng.choice(len(sample), min(PROBES, len(sample)), replace=False)
    forest = Forest(sample, centre)
    strings = hash_strings(sample[probe], centre)
    counts = forest.counts(strings)
    truth = []
    for p in probe:
        d = distances(sample, sample[p])
        d[p] = np.inf
        truth.append(np.argpartition(d, k)[:k])
    for share in SHARES:
        found = forest.candidates(strings, stop_level(counts, share * len(sample)))
        if np.mean([np.isin(t, c).mean() for t, c in zip(truth, found, strict=True)]) >= TARGET:
            return share
    return 1.0


def _matrix(column, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def nearest(vectors: DataFrame, query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) for the rows that the condition `query` selects."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("ask"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = base.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad & F.exists("v", lambda x: x != 0))
    width = base.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if width is None:
        return spark.createDataFrame([], out)
    width = width["width"]
    base = base.filter(F.size("v") == width).groupBy("id").agg(F.min("v").alias("v"), F.max("ask").alias("ask"))  # one row an id
    # equal vectors: one point with its k + 1 smallest ids
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    ids = base.withColumn("place", place).filter(F.col("place") <= k + 1)
    points = cut(ids.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("home", F.xxhash64("v")), "points")
    n = points.count()
    sample = _matrix(points.orderBy("home").limit(SAMPLE).select("v").toArrow()["v"], width)
    centre = sample.mean(0)
    share = fit_share(sample, k, centre)
    # a point counts once a tree at most, so this many hold k others than the query's own
    enough = float("inf") if share >= 1 else max(share * n, TREES * (k + 1))
    shards, asked = max(1, -(-n // SHARD_ROWS)), cut(base.filter("ask").select("id", "v"), "asked")
    blocks = max(1, -(-asked.count() // QUERIES))
    rows = points.select(F.pmod("home", F.lit(shards)).cast("int").alias("shard"), "ids", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asks = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        strings = hash_strings(_matrix(right["v"], width), centre)
        if len(left) and len(right):
            found = Forest(_matrix(left["v"], width), centre).counts(strings)
        else:
            found = np.zeros((len(right), BITS + 1), np.int64)
        return pa.table({"id": right["id"], "counts": pa.array(found.tolist(), pa.list_(pa.int64()))})

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids, near, score = [], [], []
        if len(left) and len(right):
            forest = Forest(_matrix(left["v"], width), centre)
            q = _matrix(right["v"], width)
            level = right["level"].to_numpy()
            own = left["ids"].to_pylist()
            for j, (query_id, at) in enumerate(zip(right["id"].to_pylist(), forest.candidates(hash_strings(q, centre), level), strict=True)):
                d = distances(forest.vectors[at], q[j])
                # one more than k points: one of them may be the query's own
                if len(d) > k + 1:
                    cutoff = np.partition(d, k)[k]
                    at, d = at[d <= cutoff], d[d <= cutoff]
                best = sorted((x, i) for x, p in zip(d.tolist(), at.tolist(), strict=True) for i in own[p] if i != query_id)[:k]
                query_ids += [query_id] * len(best)
                near += [i for _, i in best]
                score += [x for x, _ in best]
        return pa.table({"query_id": pa.array(query_ids, pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(score, pa.float64())})

    def meet(found: DataFrame, with_queries: DataFrame, f, schema: str) -> DataFrame:
        everywhere = with_queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        return found.groupBy("shard", "block").cogroup(everywhere.groupBy("shard", "block")).applyInArrow(f, schema)

    levels = meet(rows, asks, count, "id bigint, counts array<bigint>").select("id", F.posexplode("counts").alias("level", "n"))
    sums = levels.groupBy("id", "level").agg(F.sum("n").alias("n"))
    stop = sums.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("n") >= enough, F.col("level"))), F.lit(0)).cast("bigint").alias("level"))
    ready = cut(asks.join(stop, "id"), "levels")
    best = meet(rows, ready, rank, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
