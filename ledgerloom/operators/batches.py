"""A training batch from one table of observations: a split, fitted features, sampled episodes, targets and a first forecast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import flat, future_path_rms, scaled_target
from ledgerloom.operators import audit, fit, pairs, runs, states
from ledgerloom.schema import DEPTH, FEATURE_VERSION
from ledgerloom.session import written
from ledgerloom.sources.store import write_document


@dataclass
class TrainingBatch:
    #: anchor, x (history of standardised features), y (log path)
    episodes: DataFrame
    #: a, b, d_raw, d
    pairs: DataFrame
    #: the first held-out episode
    query: DataFrame
    moments: DataFrame
    report: dict


def build_batch(observations: DataFrame, history: int, horizon: int, anchors: int, seed: int, split_row: int | None = None, depth: int = DEPTH) -> TrainingBatch:
    """The batch of one session's observations (session, source_row, segment, ts, mid, x).

    The first two thirds of the rows train, the rest is held out. Features are fitted on the rows that any training history
    uses. Episodes are a sample of the training anchors, pairs those of them a history and a horizon apart; the held-out
    split's first episode is forecast by the nearest sampled one.
    """
    spark = observations.sparkSession
    rows = written(audit.as_ticks(written(observations, "observed")), "rows")
    if rows.select("session").distinct().count() != 1:
        raise ValueError("a batch is made of one session")
    n = rows.count()
    split = 2 * n // 3 if split_row is None else split_row
    train, held = runs.valid_anchors(rows, history, horizon, 0, split), runs.valid_anchors(rows, history, horizon, split)
    counts = [df.count() for df in (train, held)]
    if not all(counts):
        raise ValueError("the training and the held-out part must have whole episodes")
    if not 2 <= anchors <= counts[0]:
        raise ValueError(f"the number of anchors must lie in 2 .. {counts[0]}")
    chosen = written(fit.bottom_k(train, "anchor", seed, anchors).select("session", "run", "anchor"), "anchors")
    eligible = written(pairs.eligible_pairs(chosen, history + horizon), "pairs")
    n_pairs = eligible.count()
    if not n_pairs:
        raise ValueError("the sampled anchors have no eligible pair")
    used = runs.coverage(runs.history_ranges(runs.anchor_ranges(runs.runs(rows.filter(F.col("row_id") < split)), history, horizon), history))
    fitted_on = written(_within(rows, used), "fitted")
    tau = fit.positive_median(fitted_on.select(F.col("x")[8 * depth + 1].alias("gap")), "gap").first()["median"] or 1.0
    moments = written(fit.feature_moments(fitted_on, tau, depth), "features")
    ticks = fit.standardise(rows, moments, tau, depth)
    first = held.orderBy("anchor").limit(1)
    wanted = chosen.select("session", "anchor").unionByName(first.select("session", "anchor"))
    x = runs.histories(ticks.select("session", "run", "row_id", "brk", "z"), wanted, "z", history, "array<array<double>>")
    y = runs.futures(rows, horizon, history).select("session", "anchor", "y")
    both = written(x.join(y, ["session", "anchor"]), "episodes")
    query = both.join(first.select("anchor"), "anchor")
    episodes = both.join(chosen.select("anchor"), "anchor")
    ends = episodes.select("anchor", "y")
    raw = eligible.select("a", "b").join(ends.toDF("a", "ya"), "a").join(ends.toDF("b", "yb"), "b").select("a", "b", future_path_rms(F.col("ya"), F.col("yb")).alias("d_raw"))
    raw = written(raw.withColumn("place", F.col("a") * n + F.col("b")), "raw")
    scale = fit.target_scale(raw, "d_raw", "place").first().asDict()
    if not scale["scale"]:
        raise ValueError("no pair has a positive distance")
    scaled = raw.select("a", "b", "d_raw", scaled_target(F.col("d_raw"), scale["scale"]).alias("d"))
    near = states.nearest_in_library(query.select("anchor", flat(F.col("x")).alias("v")), episodes.select("anchor", flat(F.col("x")).alias("v")), "anchor", "v").first()
    paths = query.select(F.col("y").alias("ya")).crossJoin(episodes.filter(F.col("anchor") == near["nearest"]).select(F.col("y").alias("yb")))  # one row beside one row
    error = paths.select(future_path_rms(F.col("ya"), F.col("yb"))).first()[0]
    extremes = scaled.agg(F.min("d"), F.max("d")).first()
    report = {
        "version": FEATURE_VERSION, "rows": n, "segments": rows.select("run").distinct().count(), "history": history, "horizon": horizon, "split_row": split, "train_anchors": counts[0],
        "held_out_anchors": counts[1], "anchors": anchors, "pairs": n_pairs, "fitted_rows": fitted_on.count(), "tau": tau, "scale": scale, "scaled_range": [extremes[0], extremes[1]],
        "query_anchor": near["query"], "nearest_anchor": near["nearest"], "nearest_distance": near["distance"], "forecast_rms": error,
    }
    return TrainingBatch(episodes, scaled, query, moments, report)


def _within(rows: DataFrame, ranges: DataFrame, block: int = 4096) -> DataFrame:
    """The rows in any of the disjoint ranges of their session."""
    touched = ranges.select("session", "start", "stop", F.explode(F.sequence(F.call_function("div", F.col("start"), F.lit(block)), F.call_function("div", F.col("stop") - 1, F.lit(block)))).alias("_block"))
    met = rows.withColumn("_block", F.call_function("div", F.col("row_id"), F.lit(block))).join(touched, ["session", "_block"])
    return met.filter((F.col("row_id") >= F.col("start")) & (F.col("row_id") < F.col("stop"))).select(*rows.columns)


def save_batch(batch: TrainingBatch, path: str) -> dict:
    """The batch's tables as Parquet and its report as a document; never over another."""
    for name in ("episodes", "pairs", "query", "moments"):
        getattr(batch, name).write.mode("errorifexists").parquet(f"{path}/{name}")
    return write_document(batch.episodes.sparkSession, f"{path}/report.json", batch.report)
