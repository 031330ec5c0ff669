"""Connected components of an edge table, by alternating large-star and small-star steps.

A node that most edges meet, as a group's centre does, is joined apart, so that its edges stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import HOT_ROWS, MOST_HOT, Cut, join_hot

#: Edges of a node from which they stay where they are.
HOT_EDGES = 512


def _hot(both: DataFrame, rows: int) -> DataFrame | None:
    """u of the nodes that more than HOT_EDGES of the rows meet, and more than the MOST_HOT-th part: MOST_HOT at most."""
    limit = max(HOT_EDGES, rows // MOST_HOT)
    if rows <= limit:
        return None
    found = both.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("u").toArrow()
    return both.sparkSession.createDataFrame(found) if len(found) else None  # by Arrow, so no Python worker is started for it


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hot = _hot(both, 2 * rows)
    parts = [(both, False)] if hot is None else [(both.join(F.broadcast(hot), "u", "left_anti"), False), (both.join(F.broadcast(hot), "u", "left_semi"), True)]
    out = None
    for part, few in parts:
        least = part.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = part.join(F.broadcast(least) if few else least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved if out is None else out.unionByName(moved)
    return out


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = join_hot(down, least, ["u"], rows=rows).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge (u, v) but the roots themselves; a root is its component's least node."""
    kept = Cut(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, rows = None, kept.df.count()
    for _ in range(most_rounds):
        large = _large_star(kept.df, rows).distinct()  # a node's neighbours in one star say the same
        if rows > HOT_ROWS:  # it is read more than once
            large = Cut(large, "large").df
        step = Cut(_small_star(large, rows).distinct(), "star")
        kept.drop()
        kept = step
        now = tuple(kept.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, rows = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return kept.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
