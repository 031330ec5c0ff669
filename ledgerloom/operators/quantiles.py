"""Exact order statistics without gathering the values: histograms of ever narrower stretches, one aggregation each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import written

#: Cells of a histogram, and values of a stretch that are sorted in one task.
CELLS, FEW = 4096, 1_000_000


def _order_statistics(rows: DataFrame, n: int, wanted: list[int], few: int) -> dict[int, float]:
    """The values (column v, no nulls) at the wanted places in ascending order, from 0."""
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    open_ = [(float(ends["lo"]), float(ends["hi"]), 0, n, sorted(set(wanted)))]  # least and greatest value, rows below, rows, places
    found: dict[int, float] = {}
    while open_:
        narrow, wide = [], []
        for lo, hi, below, count, places in open_:
            if lo == hi:
                found |= {p: lo for p in places}
            else:
                (narrow if count <= few else wide).append((lo, hi, below, count, places))
        open_ = []
        for lo, hi, below, _, places in narrow:
            values = rows.filter(F.col("v").between(lo, hi)).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()  # `few` values at most
            at, k = below, 0
            for p in places:
                while at + values[k]["n"] <= p:
                    at, k = at + values[k]["n"], k + 1
                found[p] = float(values[k]["v"])
        if not wide:
            continue
        # the stretch of each value, and its cell there; rounding may misplace a value but not out of order
        cell = F.lit(None).cast("struct<s: int, c: int>")
        for s, (lo, hi, *_) in enumerate(wide):
            if lo < 0 < hi:
                part = (F.col("v") >= 0).cast("int")
            elif lo > 0 and hi / lo > 2 * CELLS:
                part = F.floor(F.log2("v")).cast("int")  # by exponents first, so that no scale takes many rounds
            elif hi < 0 and lo / hi > 2 * CELLS:
                part = -F.floor(F.log2(-F.col("v"))).cast("int")
            else:
                part = F.floor((F.col("v") - F.lit(lo)) / F.lit((hi - lo) / CELLS if math.isfinite(hi - lo) else hi / CELLS - lo / CELLS)).cast("int")
            cell = F.when(F.col("v").between(lo, hi), F.struct(F.lit(s).alias("s"), part.alias("c"))).otherwise(cell)
        cells = rows.withColumn("cell", cell).filter("cell is not null").groupBy("cell").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        by_stretch: dict[int, list] = {}
        for r in cells.collect():
            by_stretch.setdefault(r["cell"]["s"], []).append(r)
        for s, (_, _, below, _, places) in enumerate(wide):
            at = below
            for r in sorted(by_stretch[s], key=lambda r: (r["lo"], r["hi"])):
                own = [p for p in places if at <= p < at + r["n"]]
                if own:
                    open_.append((float(r["lo"]), float(r["hi"]), at, r["n"], own))
                at += r["n"]
    return found


def exact_quantiles(df: DataFrame, value: Column, probabilities: list[float], few: int = FEW, stored: bool = False) -> tuple[int, list[float | None]]:
    """(number of values, their quantiles by linear interpolation), nulls and NaN left out.

    Up to `few` values are sorted in one task, as Spark's percentile does; more are narrowed down by histograms of CELLS
    cells, of which the driver gets one row each, until few are left around each place. stored: df is cheap to read again;
    else its values are written first.
    """
    rows = df.select(value.cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = rows if stored else written(rows, "values")  # they are read in every round
    n = rows.count()
    if not n:
        return 0, [None] * len(probabilities)
    if n <= few:
        return n, list(rows.agg(F.percentile("v", F.array(*map(F.lit, probabilities)))).first()[0])
    places = [p * (n - 1) for p in probabilities]
    got = _order_statistics(rows, n, [f(x) for x in places for f in (math.floor, math.ceil)], few)
    out = []
    for x in places:
        lo, hi = got[math.floor(x)], got[math.ceil(x)]
        out.append(lo if lo == hi else lo + (x - math.floor(x)) * (hi - lo))
    return n, out
