"""Quantised states of latents and what followed them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import hash_priority, plain_count
from ledgerloom.operators.pairs import fingerprint
from ledgerloom.operators.quantiles import FEW, exact_quantiles
from ledgerloom.session import written
from ledgerloom.sources.store import read_document, write_document

#: Numbers (rows * width) that a codebook may hold to be sent to every task.
MOST_CODEBOOK = 64_000_000


def codebook_of_groups(latents: DataFrame, code: str, vector: str) -> DataFrame:
    """code, prototype: the mean vector of each group."""
    parts = latents.select(F.col(code).alias("code"), F.posexplode(vector).alias("at", "v"))
    means = parts.groupBy("code", "at").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("prototype"))


def read_codebook(codebook: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(codes in order, prototypes) on the driver, after a check of the size."""
    n, width = codebook.count(), codebook.select(F.max(F.size("prototype"))).first()[0] or 0
    if n * width > MOST_CODEBOOK:
        raise ValueError("the codebook is too large to send to every task")
    rows = codebook.orderBy("code").collect()
    return np.array([r["code"] for r in rows]), np.array([r["prototype"] for r in rows], np.float64)


def encode(latents: DataFrame, codebook: DataFrame, vector: str, block: int = 4096) -> DataFrame:
    """The latents with `code` and `distance` of the nearest prototype (ties: the least code), by matrix products."""
    codes, prototypes = read_codebook(codebook)
    shared = latents.sparkSession.sparkContext.broadcast((codes, prototypes, (prototypes**2).sum(1)))

    @F.pandas_udf("code int, distance double")
    def assign(column: pd.Series) -> pd.DataFrame:
        own, p, norms = shared.value
        x = np.array(column.tolist(), np.float64).reshape(-1, p.shape[1])
        best, distance = np.zeros(len(x), int), np.zeros(len(x))
        for i in range(0, len(x), block):
            part = x[i : i + block]
            k = (norms - 2 * part @ p.T).argmin(1)
            best[i : i + block], distance[i : i + block] = k, np.sqrt(((part - p[k]) ** 2).sum(1))
        return pd.DataFrame({"code": own[best].astype("int32"), "distance": distance})

    return latents.withColumn("_found", assign(F.col(vector))).select(*latents.columns, "_found.code", "_found.distance")


def decode(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    return codes.join(codebook, "code")


def occupancy(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("code").agg(F.count("*").alias("n"))


def code_stats(assigned: DataFrame, few: int = FEW) -> DataFrame:
    """active, total, mse, mean_l2, max_l2, entropy_bits, effective_states, support quantiles, distance quantiles; one row."""
    total = assigned.agg(F.count("*").alias("total"), F.avg(F.col("distance") * F.col("distance")).alias("mse"), F.avg("distance").alias("mean_l2"), F.max("distance").alias("max_l2"))
    marks = (50, 90, 95, 99)
    for q, value in zip(marks, exact_quantiles(assigned, F.col("distance"), [q / 100 for q in marks], few)[1], strict=True):
        total = total.withColumn(f"p{q}", F.lit(value).cast("double"))
    counts = occupancy(assigned).crossJoin(total.select(F.col("total").alias("all")))  # one row beside one row a code
    p = F.col("n") / F.col("all")
    support = counts.agg(F.count("*").alias("active"), (-F.sum(p * F.log2(p))).alias("entropy_bits"), F.min("n").alias("min_support"), F.median("n").alias("median_support"), F.max("n").alias("max_support"))
    return total.crossJoin(support).withColumn("effective_states", F.pow(F.lit(2.0), F.col("entropy_bits")))


def state_futures(assigned: DataFrame, path: str = "y") -> DataFrame:
    """code, step, n, mean, var (population) of the futures seen from each state."""
    parts = assigned.select("code", F.posexplode(path).alias("step", "v"))
    return parts.groupBy("code", "step").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))


def state_samples(assigned: DataFrame, key: str, seed: int, k: int, path: str = "y") -> DataFrame:
    """Up to k futures of each state, by least hash priority."""
    from ledgerloom.operators.fit import bottom_k

    return bottom_k(assigned.select("code", key, path), key, seed, k, ["code"])


def mean_paths(futures: DataFrame) -> DataFrame:
    """code, n, path: mean futures as arrays."""
    return futures.groupBy("code").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("step", "mean"))), lambda s: s["mean"]).alias("path"))


def forecast_errors(held_out: DataFrame, futures: DataFrame, path: str = "y") -> DataFrame:
    """Coverage, and errors of three forecasts: the state's mean future, the overall mean, and no move at all.

    Rows whose state was never seen count in `rows` and nowhere else.
    """
    overall = futures.groupBy("step").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("overall"))
    known = futures.select("code", "step", "n", "mean").join(F.broadcast(overall), "step")  # one row a step
    parts = held_out.select("code", "distance", F.monotonically_increasing_id().alias("_row"), F.size(path).alias("_size"), F.posexplode(path).alias("step", "v"))
    both = parts.join(known, ["code", "step"], "left")
    seen, last = F.col("n").isNotNull(), F.col("step") == F.col("_size") - 1
    out = [F.sum((F.col("step") == 0).cast("int")).alias("rows"), F.sum(((F.col("step") == 0) & seen).cast("int")).alias("supported")]
    for name, guess in (("state", F.col("mean")), ("overall", F.col("overall")), ("zero", F.lit(0.0))):
        e = F.when(seen, F.col("v") - guess)
        out += [F.avg(e * e).alias(f"{name}_mse"), F.avg(F.when(last, F.abs(e))).alias(f"{name}_terminal_mae"), F.sqrt(F.avg(F.when(last, e * e))).alias(f"{name}_terminal_rmse")]
    once = F.when((F.col("step") == 0) & seen, F.lit(1))
    out += [F.avg(once * F.col("n")).alias("mean_support"), F.avg(once * F.col("distance")).alias("mean_distance"), F.max(once * F.col("distance")).alias("max_distance")]
    return both.agg(*out).withColumn("coverage", F.col("supported") / F.col("rows"))


def distance_errors(df: DataFrame, predicted: str, target: str) -> DataFrame:
    e = F.col(predicted) - F.col(target)
    return df.agg(F.count("*").alias("pairs"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(predicted).alias("mean_predicted"), F.avg(target).alias("mean_target"))


def project(df: DataFrame, vector: str, weights, bias) -> DataFrame:
    """`z` = weights * vector + bias by a matrix that every task gets, after a check of its size; refuses other widths."""
    w, b = np.asarray(weights, np.float64), np.asarray(bias, np.float64)
    if w.ndim != 2 or b.shape != w.shape[:1] or not np.isfinite(w).all() or not np.isfinite(b).all():
        raise ValueError("weights must be a finite matrix with one bias a row")
    if w.size > MOST_CODEBOOK:
        raise ValueError("the matrix is too large to send to every task")
    shared = df.sparkSession.sparkContext.broadcast((w, b))

    @F.pandas_udf("array<double>")
    def times(column: pd.Series) -> pd.Series:
        w, b = shared.value
        if any(len(x) != w.shape[1] for x in column):
            raise ValueError(f"vectors must have {w.shape[1]} numbers")
        return pd.Series(list(np.array(column.tolist(), np.float64).reshape(-1, w.shape[1]) @ w.T + b))

    return df.withColumn("z", times(F.col(vector)))


def nearest_in_library(queries: DataFrame, library: DataFrame, key: str, vector: str, block: int = 2048) -> DataFrame:
    """query, nearest, distance: of each query the library row with the least Euclidean distance, ties to the smaller key.

    Queries meet the library in blocks: queries are dealt to blocks by hash and each task sees a stretch of the library
    with one block of queries (a row a query and task comes out), so neither side has to fit a task.
    """
    shared = queries.select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("q"))
    blocks = max(1, -(-shared.count() // block))
    asked = shared.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    n = int(library.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = library.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n)))
    left = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))).withColumnsRenamed({"shard": "shard_", "block": "block_"})

    def meet(q: pa.Table, v: pa.Table) -> pa.Table:
        if not len(q) or not len(v):
            return pa.table({"query": pa.array([], pa.int64()), "nearest": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        v = v.sort_by("key")
        x, y = (np.array(t.to_pylist(), np.float64) for t in (q["q"], v["v"]))
        best = np.empty(len(x), np.int64)
        for i in range(0, len(x), 64):
            best[i : i + 64] = ((x[i : i + 64, None, :] - y[None]) ** 2).sum(2).argmin(1) if len(y) * y.shape[1] < 1_000_000 else [((y - r) ** 2).sum(1).argmin() for r in x[i : i + 64]]
        return pa.table({"query": q["query"], "nearest": pa.array(v["key"].to_numpy()[best]), "distance": pa.array(np.sqrt(((x - y[best]) ** 2).sum(1)))})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard_", "block_")).applyInArrow(meet, "query bigint, nearest bigint, distance double")
    best = found.groupBy("query").agg(F.min(F.struct("distance", "nearest")).alias("b"))
    return best.select("query", "b.nearest", "b.distance")


# --- codebooks ---


def codebook_frame(spark: SparkSession, prototypes: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(prototypes)], "code int, prototype array<double>")


def lloyd_step(latents: DataFrame, codebook: DataFrame, vector: str) -> DataFrame:
    """code, n, prototype: the mean of the latents assigned to each prototype; a code without any keeps its own."""
    parts = encode(latents.select(vector), codebook, vector).select("code", F.posexplode(vector).alias("at", "v"))
    sums = parts.groupBy("code", "at").agg(F.count("*").alias("n"), F.avg(F.col("v").cast("double")).alias("v"))
    means = sums.groupBy("code").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("mean"))
    both = codebook.join(means, "code", "left")
    return both.select("code", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", "prototype").alias("prototype"))


class CodebookError(RuntimeError):
    """A codebook used before it is frozen, fitted after, or of another shape than said."""


class MiniBatchCodebook:
    """k-means in mini-batches: candidates on a warm-up sample, then one pass of updates with falling rates, then frozen.

    The warm-up sample holds the rows of least hash priority (three batches, or three rows a state, at least); of n_init
    seeded candidates the one with the least error on it begins. Batches are classes of the key's hash, so they are the
    same however the latents come; each is assigned by all tasks, and what the driver gets of it is one row a state and
    coordinate. A prototype moves to the mean of all rows it ever got. States that never get a row stay as they began.
    """

    def __init__(self, states: int, batch: int = 65_536, init_size: int | None = None, n_init: int = 3, seed: int = 17):
        self.states, self.batch, self.n_init = plain_count(states, "states"), plain_count(batch, "batch"), plain_count(n_init, "n_init")
        self.init_size = max(3 * self.batch, 3 * self.states) if init_size is None else plain_count(init_size, "init_size")
        if self.init_size < self.states:
            raise ValueError("init_size must be at least states")
        self.seed, self.prototypes, self.counts, self.frozen, self.rows = seed, None, None, False, 0

    def fit(self, latents: DataFrame, vector: str, key: str) -> MiniBatchCodebook:
        if self.frozen:
            raise CodebookError("the codebook is frozen")
        rows = written(latents.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")), "latents")
        self.rows = rows.count()
        if self.rows < self.states:
            raise CodebookError(f"{self.rows} latents for {self.states} states")
        width = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
        if width[0] != width[1] or self.init_size * width[0] > MOST_CODEBOOK:
            raise CodebookError("latents must have one width, and a warm-up sample that fits the driver")
        first = rows.withColumn("priority", hash_priority(F.col("key"), self.seed)).orderBy("priority", "key").limit(self.init_size)
        sample = np.array([r["v"] for r in first.select("v").collect()], np.float64)
        tries = [self._candidate(sample, self.seed + k) for k in range(self.n_init)]
        self.prototypes = min(tries, key=lambda c: self._errors(sample, c).sum())
        self.counts = np.zeros(self.states, np.int64)
        batches = max(1, -(-self.rows // self.batch))
        for k in range(batches):
            part = rows.filter(F.pmod(F.xxhash64("key", F.lit(self.seed)), F.lit(batches)) == k)
            self._update(encode(part, codebook_frame(rows.sparkSession, self.prototypes), "v"))
        return self

    def _update(self, assigned: DataFrame) -> None:
        parts = assigned.select("code", F.posexplode("v").alias("at", "x")).groupBy("code", "at").agg(F.count("*").alias("n"), F.sum("x").alias("x")).collect()
        sums, n = np.zeros_like(self.prototypes), np.zeros(self.states, np.int64)
        for r in parts:
            sums[r["code"], r["at"]], n[r["code"]] = r["x"], r["n"]
        got = n > 0
        total = self.counts + n
        self.prototypes[got] = (self.prototypes[got] * self.counts[got, None] + sums[got]) / total[got, None]
        self.counts = total

    @staticmethod
    def _errors(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(1) + ((c * c).sum(1) - 2 * x @ c.T).min(1), 0)

    def _candidate(self, x: np.ndarray, seed: int, rounds: int = 10) -> np.ndarray:
        """k-means++ beginnings (far rows likelier), then a few plain rounds."""
        rng = np.random.default_rng(seed)
        c = x[rng.integers(len(x))][None]
        while len(c) < self.states:
            e = self._errors(x, c)
            c = np.concatenate([c, x[rng.choice(len(x), p=e / e.sum())][None] if e.sum() > 0 else x[rng.integers(len(x))][None]])
        for _ in range(rounds):
            own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            n = np.bincount(own, minlength=self.states)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        return c

    def freeze(self, spark: SparkSession) -> DataFrame:
        """code, prototype; no fit goes on afterwards."""
        if self.prototypes is None:
            raise CodebookError("nothing has been fitted")
        self.frozen = True
        return codebook_frame(spark, self.prototypes)


def save_codebook(codebook: DataFrame, path: str, about: dict) -> dict:
    """A frozen codebook as Parquet with a document of its shape, digest and what it was made of; never over another."""
    spark = codebook.sparkSession
    codes, prototypes = read_codebook(codebook)
    if codes.tolist() != list(range(len(codes))) or prototypes.ndim != 2 or not len(codes) or not np.isfinite(prototypes).all():
        raise CodebookError("codes must be 0, 1, ... with finite prototypes of one width")
    codebook.orderBy("code").coalesce(1).write.mode("errorifexists").parquet(f"{path}/prototypes")
    return write_document(spark, f"{path}/codebook.json", {"states": len(codes), "width": prototypes.shape[1], "digest": fingerprint(prototypes.tolist()), "frozen": True, "about": about})


def load_codebook(spark: SparkSession, path: str, **about) -> DataFrame:
    """The codebook; refuses other shapes or values than its document says, one not frozen, and other lineage than `about`."""
    document = read_document(spark, f"{path}/codebook.json", frozen=True)
    for k, v in about.items():
        if document["about"].get(k) != v:
            raise CodebookError(f"the codebook's {k} is {document['about'].get(k)!r}, not {v!r}")
    codebook = spark.read.parquet(f"{path}/prototypes")
    codes, prototypes = read_codebook(codebook)
    if codes.tolist() != list(range(document["states"])) or prototypes.shape[1:] != (document["width"],) or fingerprint(prototypes.tolist()) != document["digest"]:
        raise CodebookError(f"{path}: not what its document says")
    return codebook


def save_futures(futures: DataFrame, path: str, states: int, horizon: int, about: dict) -> dict:
    """state_futures() as Parquet, a row a code and step, with a document; refuses codes or steps out of range, or missing steps."""
    bad = futures.filter((F.col("code") < 0) | (F.col("code") >= states) | (F.col("step") < 0) | (F.col("step") >= horizon) | (F.col("n") < 1) | (F.col("var") < 0) | F.isnan("mean"))
    if not bad.isEmpty():
        raise ValueError("a code, a step, a count or a variance out of range")
    if not futures.groupBy("code").agg(F.count("*").alias("k"), F.countDistinct("step").alias("d"), F.countDistinct("n").alias("c")).filter((F.col("k") != horizon) | (F.col("d") != horizon) | (F.col("c") != 1)).isEmpty():
        raise ValueError("a state without one row for each step")
    futures.select("code", "step", "n", "mean", "var").write.mode("errorifexists").parquet(f"{path}/futures")
    total = futures.sparkSession.read.parquet(f"{path}/futures").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    return write_document(futures.sparkSession, f"{path}/futures.json", {"states": states, "horizon": horizon, "rows": total["rows"], "n": total["n"], "about": about})


def load_futures(spark: SparkSession, path: str, states: int, horizon: int, **about) -> DataFrame:
    document = read_document(spark, f"{path}/futures.json", states=states, horizon=horizon)
    for k, v in about.items():
        if document["about"].get(k) != v:
            raise ValueError(f"the summary's {k} is {document['about'].get(k)!r}, not {v!r}")
    rows = spark.read.parquet(f"{path}/futures")
    total = rows.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    if (total["rows"], total["n"]) != (document["rows"], document["n"]):
        raise ValueError(f"{path}: not what its document says")
    return rows


# --- encoders ---


def train_projection(spark: SparkSession, x: np.ndarray, pairs: np.ndarray, target: np.ndarray, width: int, steps: int = 200, rate: float = 1e-2, decay: float = 1e-2, clip: float = 1.0, batch: int = 256, seed: int = 17, state: dict | None = None, probe: tuple | None = None, every: int = 50):
    """Weights and bias of a linear encoder whose latent distances match the targets: AdamW on batches of pairs.

    x: the sampled histories, flat; pairs: rows of x. Returns (weights, bias, losses, state, curve). A state from an earlier
    call goes on where that ended, as if there had been one call. curve: (step, mean squared error) on the probe (x, pairs,
    targets, frozen before) every so many steps. Raises on a non-finite loss or another shape than the state's.
    """
    if state is None:
        w = np.random.default_rng(seed).normal(0, 1 / np.sqrt(x.shape[1]), (width, x.shape[1]))
        state = {"w": w, "m": np.zeros_like(w), "v": np.zeros_like(w), "step": 0, "seed": seed}
    if state["w"].shape != (width, x.shape[1]) or state["seed"] != seed:
        raise ValueError("the state is that of another encoder")
    w, m, v = state["w"].copy(), state["m"].copy(), state["v"].copy()
    losses, curve = [], []
    for t in range(state["step"] + 1, state["step"] + steps + 1):
        at = np.random.default_rng((seed, t)).choice(len(pairs), min(batch, len(pairs)), replace=False)  # a step's batch is its own
        d = x[pairs[at, 0]] - x[pairs[at, 1]]
        z = d @ w.T
        r = np.sqrt((z * z).sum(1) + 1e-12)
        e = r - target[at]
        losses.append(float((e * e).mean()))
        if not np.isfinite(losses[-1]):
            raise FloatingPointError("the loss is not finite")
        g = ((2 * e / r / len(at))[:, None] * z).T @ d
        g *= min(1.0, clip / max(np.linalg.norm(g), 1e-12))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + decay * w)
        if probe is not None and t % every == 0:
            curve.append((t, projection_error(w, *probe)))
    return w, np.zeros(width), losses, {"w": w, "m": m, "v": v, "step": state["step"] + steps, "seed": seed}, curve


def projection_error(w: np.ndarray, x: np.ndarray, pairs: np.ndarray, target: np.ndarray) -> float:
    """Mean squared difference of latent and target distances."""
    d = np.sqrt((((x[pairs[:, 0]] - x[pairs[:, 1]]) @ w.T) ** 2).sum(1))
    return float(((d - target) ** 2).mean())


def save_training(spark: SparkSession, path: str, state: dict, about: dict) -> dict:
    """A trainer's state as a document; `about` names the data it was trained on."""
    return write_document(spark, path, {"w": state["w"].tolist(), "m": state["m"].tolist(), "v": state["v"].tolist(), "step": state["step"], "seed": state["seed"], "about": about}, overwrite=True)


def load_training(spark: SparkSession, path: str, about: dict) -> dict:
    found = read_document(spark, path, about=about)
    return {**{k: np.array(found[k]) for k in "wmv"}, "step": found["step"], "seed": found["seed"]}
