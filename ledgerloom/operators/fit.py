"""Statistics fitted on training rows only: gap medians, feature moments, target scales, samples, and fits that go on."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import hash_priority, prepared, protected, standardised
from ledgerloom.operators.quantiles import FEW, exact_quantiles
from ledgerloom.schema import DEPTH, FEATURE_VERSION, feature_names
from ledgerloom.session import written
from ledgerloom.sources.store import exists, read_document, write_document


def positive_median(df: DataFrame, column: str, few: int = FEW) -> DataFrame:
    """Exact median of the positive values, with how many there are; one row."""
    n, (median,) = exact_quantiles(df.filter(F.col(column) > 0), F.col(column), [0.5], few)
    return df.sparkSession.createDataFrame([(median, n)], "median double, n bigint")


def bottom_k(df: DataFrame, key: str, seed: int, k: int, by: list[str] | None = None) -> DataFrame:
    """The k rows (of each group) with the least hash priority, ties to the smaller key: a sample that no partitioning changes.

    Without groups, rows beyond a priority that about k rows lie below, with a wide margin, are left out first, so that
    the final sort gets little more than k rows however many tasks there are.
    """
    ranked = df.withColumn("priority", hash_priority(F.col(key), seed))
    if not by:
        n = df.count()
        if n > 4 * k:
            low = ranked.filter(F.col("priority") < F.lit(int((k + 10 * math.sqrt(k) + 100) / n * 2**60)))
            ranked = low if low.count() >= k else ranked
        return ranked.orderBy("priority", key).limit(k)
    w = Window.partitionBy(*by).orderBy("priority", key)
    return ranked.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= k).drop("_place")


def reservoir_median(df: DataFrame, column: str, key: str, seed: int, k: int = 1_000_000) -> DataFrame:
    """Median of a bottom-k sample of the positive values."""
    return bottom_k(df.filter(F.col(column) > 0), key, seed, k).agg(F.median(column).alias("median"), F.count("*").alias("n"))


# --- moments ---


def batch_moments(observations: DataFrame, tau: float, unit: str | None = None, depth: int = DEPTH) -> DataFrame:
    """[unit,] place, n, mean, m2 (squares about the mean) of each prepared feature over the valid rows of each Arrow batch.

    Counts and gaps are taken on a log scale, as functions.scalars.prepared does; a negative one fails the query.
    """
    if tau <= 0:
        raise ValueError("tau must be positive")
    names = feature_names(depth)
    width = len(names)
    logs = np.array([n.endswith(("_quantity", "_orders")) or n == "time_delta_seconds" for n in names])
    over = np.array([tau if n == "time_delta_seconds" else 1.0 for n in names])
    # the presence feature on which a feature's validity depends, or -1
    flag = np.array([i // 4 * 4 + 3 if i < 8 * depth and not n.endswith("_present") else -1 for i, n in enumerate(names)])

    def moments(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            if (x[:, logs] < 0).any():
                raise ValueError("a quantity, a number of orders or a gap is negative")
            v = np.where(logs, np.log1p(np.where(logs, x, 0) / over), x)
            valid = np.where(flag >= 0, x[:, flag] > 0, True)
            units, own = (None, np.zeros(len(x), int)) if unit is None else np.unique(batch.column(1).to_numpy(zero_copy_only=False), return_inverse=True)
            for k in range(own.max(initial=-1) + 1):
                ok = valid[own == k]
                some = v[own == k]
                n = ok.sum(0)
                mean = np.where(ok, some, 0).sum(0) / np.maximum(n, 1)
                m2 = np.where(ok, (some - mean) ** 2, 0).sum(0)
                cols = [pa.array(np.arange(width)), pa.array(n), pa.array(mean), pa.array(m2)]
                head = [] if unit is None else [pa.array(np.repeat(units[k], width))]
                yield pa.RecordBatch.from_arrays(head + cols, names=([] if unit is None else [unit]) + ["place", "n", "mean", "m2"])

    kind = "" if unit is None else f"{unit} {observations.schema[unit].dataType.simpleString()}, "
    return observations.select("x", *([] if unit is None else [unit])).mapInArrow(moments, kind + "place bigint, n bigint, mean double, m2 double")


def merged_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, mean, m2 of partial moments: sums of squares about the parts' means, and of these about the whole mean."""
    sums = parts.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    both = parts.select(*keys, F.col("n").alias("_n"), F.col("mean").alias("_mean"), "m2").join(sums, keys)
    return both.groupBy(*keys, "n", "mean").agg(F.sum(F.col("m2") + F.col("_n") * (F.col("_mean") - F.col("mean")) ** 2).alias("m2"))


def fitted_features(parts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """feature, n, mean, scale (population), constant of partial moments.

    A feature without a valid row, or without spread, is constant and gets scale 1; protected ones keep mean 0, scale 1.
    """
    names = feature_names(depth)
    rows = merged_moments(parts, ["place"])
    at = (F.col("place") + 1).cast("int")
    name, keep = F.element_at(F.array(*map(F.lit, names)), at), F.element_at(F.array(*(F.lit(protected(n)) for n in names)), at)
    std = F.sqrt(F.col("m2") / F.greatest("n", F.lit(1)))
    constant = (F.col("n") == 0) | (std <= 1e-12)
    mean = F.when(keep | (F.col("n") == 0), 0.0).otherwise(F.col("mean"))
    return rows.select(name.alias("feature"), "n", mean.alias("mean"), F.when(keep | constant, 1.0).otherwise(std).alias("scale"), constant.alias("constant"))


def feature_moments(observations: DataFrame, tau: float, depth: int = DEPTH) -> DataFrame:
    """feature, n, mean, scale, constant over valid prepared values: moments of batches, written and merged."""
    return fitted_features(written(batch_moments(observations, tau, None, depth), "moments"), depth)


def standardise(observations: DataFrame, moments: DataFrame, tau: float, depth: int = DEPTH) -> DataFrame:
    """The observations with `z`, the standardised features; the moments (one row a feature) become literals."""
    fitted = {r["feature"]: (r["mean"], r["scale"]) for r in moments.collect()}
    z = [standardised(value, valid, F.lit(fitted[name][0]), F.lit(fitted[name][1])) for name, value, valid in prepared(F.col("x"), tau, depth)]
    return observations.withColumn("z", F.array(*z))


# --- fits that go on where they were left ---


def by_unit(df: DataFrame, unit: str, folder: str, identity: dict, make: Callable[[DataFrame], DataFrame], at_once: int = 64) -> DataFrame:
    """make(rows) for all units (days, sessions) of df, from `folder` for those that it has: a fit that can be resumed.

    Units are done `at_once` to a job, whose result is committed whole; a failure loses one job's units, and a call with the
    same identity goes on from there. A folder begun with another identity (sources, parameters) is refused. make() must
    keep the unit column.
    """
    spark = df.sparkSession
    identity = identity | {"unit": unit, "version": FEATURE_VERSION}
    if exists(spark, f"{folder}/identity.json"):
        read_document(spark, f"{folder}/identity.json", **identity)
    else:
        write_document(spark, f"{folder}/identity.json", identity)
    parts, units = f"{folder}/parts", {r[0] for r in df.select(unit).distinct().collect()}  # one row a unit
    done = {r[0] for r in spark.read.parquet(parts).select(unit).distinct().collect()} if exists(spark, parts) else set()
    todo = sorted(units - done)
    for i in range(0, len(todo), at_once):
        make(df.filter(F.col(unit).isin(todo[i : i + at_once]))).write.mode("append").parquet(parts)
    if not todo and not done:
        return make(df)
    return spark.read.parquet(parts)


def resumable_moments(observations: DataFrame, tau: float, unit: str, folder: str, sources: dict, depth: int = DEPTH, at_once: int = 64) -> DataFrame:
    """feature_moments() whose units are kept in `folder`."""

    def make(rows: DataFrame) -> DataFrame:
        return merged_moments(written(batch_moments(rows, tau, unit, depth), "moments"), [unit, "place"])

    return fitted_features(by_unit(observations, unit, folder, {"sources": sources, "tau": tau, "depth": depth}, make, at_once), depth)


def resumable_reservoir(gaps: DataFrame, column: str, key: str, unit: str, folder: str, sources: dict, seed: int, k: int = 1_000_000, at_once: int = 64) -> DataFrame:
    """reservoir_median() whose units' least priorities are kept in `folder`: priorities are hashes, so there's no state to save."""

    def make(rows: DataFrame) -> DataFrame:
        return bottom_k(rows.filter(F.col(column) > 0).select(unit, key, column), key, seed, k, [unit])

    kept = by_unit(gaps, unit, folder, {"sources": sources, "seed": seed, "k": k}, make, at_once)
    return kept.orderBy("priority", key).limit(k).agg(F.median(column).alias("median"), F.count("*").alias("n"))


# --- targets ---


def target_scale(distances: DataFrame, column: str, order: Column | str, few: int = FEW) -> DataFrame:
    """Median of the positive distances, counts, zero fraction, quantiles, and the medians of either half by `order`.

    order: a number, no two alike. Exact whatever the number of distances, see quantiles.exact_quantiles; one row.
    """
    spark = distances.sparkSession
    order = F.col(order) if isinstance(order, str) else order
    rows = written(distances.select(F.col(column).cast("double").alias("d"), order.alias("place")), "distances")
    marks = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)
    n, quantiles = exact_quantiles(rows, F.col("d"), list(marks), few, True)
    zeros = rows.filter("d = 0").count()
    _, (middle,) = exact_quantiles(rows, F.col("place"), [0.5], few, True)
    positive = rows.filter("d > 0")
    first, second = (positive.filter(half) for half in (F.col("place") <= F.lit(middle), F.col("place") > F.lit(middle)))
    medians = [exact_quantiles(part, F.col("d"), [0.5], few, True)[1][0] for part in (positive, first, second)]
    names = ["scale", "pairs", "zero_fraction", *(f"q{int(100 * q):03d}" for q in marks), "first_half", "second_half"]
    schema = ", ".join(f"{c} {'bigint' if c == 'pairs' else 'double'}" for c in names)
    return spark.createDataFrame([(medians[0], n, zeros / n if n else None, *quantiles, *medians[1:])], schema)
