"""Document quality: classifier evidence combined with the posteriors of a document's host and path.

A logistic classifier on shape features gives each document's own evidence. Grouped sums of that evidence and of known
labels give every host and path a beta posterior: hosts shrink toward the global rate, paths toward their host, each
level by a strength that the spread of its rates implies (method of moments), so sparse sites say little. A document's
score is its own log odds plus its path's posterior log odds, from which its own evidence and its own label are taken
out, less the global ones.

Null hosts and paths are groups of their own. Null and empty texts have the features of no words; very long ones are
read whole. A document without label counts by its evidence alone. Repeated rows count, each with the label of their
doc_id, and are returned as often as they occur. An empty table gives an empty one.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, drawn, held_out, join_hot, whole_texts

_NOISE = ("###", "%%%", "&&&", "***", "$$$", "!!", " | ")
FEATURES = 8 + len(_NOISE)
#: Sites and labelled documents at most that are joined by broadcast; beyond, by a shuffled join.
MOST_BROADCAST, MOST_LABELS = 100_000, 100_000


def features(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (FEATURES - 1)
    lines = text.split("\n")
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = np.count_nonzero((raw >= 65) & (raw <= 90))
    digit = np.count_nonzero((raw >= 48) & (raw <= 57))
    letters = np.count_nonzero(((raw | 32) >= 97) & ((raw | 32) <= 122)) + np.count_nonzero(raw >= 128)
    again = sum(map(operator.eq, words, words[1:]))
    return [
        0.0,
        len(set(words)) / n,
        again / n,
        1 - len(set(lines)) / len(lines),
        upper / max(letters, 1),
        digit / len(raw),
        letters / len(raw),
        float(np.log1p(n)),
        *(np.log1p(100 * text.count(x) / n) for x in _NOISE),
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float

    def evidence(self, texts) -> np.ndarray:
        """Probability of good quality of each text, from the text alone."""
        x = np.array([features(t) for t in texts]).reshape(-1, FEATURES)
        z = _expand((x - self.mean) / self.spread) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def _expand(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.minimum(x * x, 25)], 1)


def train(texts: list[str | None], good: list[int], prior: float, ridge: float = 1e-3, rounds: int = 60) -> QualityModel:
    """Ridge logistic regression by Newton steps; rows weigh so that the classes have the odds of `prior`."""
    x = np.array([features(t) for t in texts]).reshape(-1, FEATURES)
    y = np.asarray(good, float)
    mean, spread = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    if len(set(good)) < 2:
        return QualityModel(mean, spread, np.zeros(2 * FEATURES), 6.0 if not good or good[0] else -6.0)
    z = np.concatenate([_expand((x - mean) / spread), np.ones((len(x), 1))], 1)
    weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (len(y) - y.sum()))
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (weight * (p - y)) + ridge * b
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
        b -= step
        if np.abs(step).max() < 1e-6:
            break
    return QualityModel(mean, spread, b[:-1], float(b[-1]))


def known(labels: DataFrame) -> DataFrame:
    """One row (doc_id, good) per labelled document outside the held-out fold; of several labels the lowest."""
    rows = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("good"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, most_bytes: int = 96_000_000) -> QualityModel:
    """Learns from about `per_class` whole labelled documents of each class, chosen by a hash.

    Of several rows of a doc_id the least text counts, once; most_bytes bounds the texts in all.
    """
    rows = known(labels)
    sizes = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count("*").alias("n")).collect()}  # two rows
    some = F.lit(False)
    for value, n in sizes.items():
        some = F.when(F.col("good") == value, drawn(F.col("doc_id"), per_class, n)).otherwise(some)
    chosen = rows.filter(some)  # about per_class rows a class, so it can be broadcast
    got = whole_texts(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("good").alias("label")), most_bytes)
    good = sum(n for value, n in sizes.items() if value)
    return train([r["text"] for r in got], [int(r["label"] > 0) for r in got], good / max(sum(sizes.values()), 1))


def evidence(docs: DataFrame, model: QualityModel) -> Column:
    """The classifier's probability, as a column over `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.evidence(text))

    # said to be nondeterministic, so that no plan makes it twice for a row
    return rate.asNondeterministic()(F.col("text").cast("string"))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def with_labels(found: DataFrame, labels: DataFrame) -> DataFrame:
    """found (doc_id, ...) with `good`, the known label of its doc_id or null."""
    rows = known(labels).select(F.col("doc_id").cast("bigint").alias("doc_id"), "good")
    few = rows.limit(MOST_LABELS + 1).count() <= MOST_LABELS
    return found.join(F.broadcast(rows) if few else rows, "doc_id", "left")


def posteriors(found: DataFrame, labels: DataFrame) -> DataFrame:
    """host, path -> path_n, path_s, host_n, host_s (counts and sums), host_rate, host_strength, path_strength, global_rate.

    found: doc_id, host, path, evidence. Known labels weigh as a further observation of the document's site.
    """
    return _posteriors(with_labels(found, labels))


def _posteriors(found: DataFrame) -> DataFrame:
    paths = found.groupBy("host", "path").agg(
        (F.count("*") + F.count("good")).cast("double").alias("path_n"),
        (F.sum("evidence") + F.coalesce(F.sum("good"), F.lit(0))).alias("path_s"),
    )
    paths = cut(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s"))
    total = hosts.agg(F.sum("host_s").alias("s"), F.sum("host_n").alias("n"), F.count("*").alias("k")).first()
    rate = min(max((total["s"] or 0) / max(total["n"] or 0, 1), 1e-3), 1 - 1e-3)

    def strength(groups: DataFrame, n: str, s: str, centre: Column) -> float:
        """Pseudo-counts: p(1-p) over the variance between groups beyond what sampling gives."""
        r = groups.agg(
            F.sum(F.col(n) * (F.col(s) / F.col(n) - centre) ** 2).alias("between"),
            F.sum(F.lit(1) * centre * (1 - centre)).alias("chance"),
            F.sum(n).alias("n"),
        ).first()
        extra = ((r["between"] or 0) - (r["chance"] or 0)) / max(r["n"] or 0, 1)
        return float(min(max(rate * (1 - rate) / max(extra, 1e-6) - 1, 1), 10_000))

    host_strength = strength(hosts, "host_n", "host_s", F.lit(rate))
    hosts = hosts.select("host", "host_n", "host_s", ((F.col("host_s") + host_strength * rate) / (F.col("host_n") + host_strength)).alias("host_rate"))
    sites = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    path_strength = strength(sites, "path_n", "path_s", F.col("host_rate"))
    return sites.withColumn("host_strength", F.lit(host_strength)).withColumn("path_strength", F.lit(path_strength)).withColumn("global_rate", F.lit(rate))


def combine(docs: DataFrame, sites: DataFrame) -> DataFrame:
    """docs (with host, path, evidence and, if labels are known, good) plus host_rate, path_rate and score, the probability of good quality.

    host_rate and path_rate are posteriors without the document: neither its evidence nor its label counts in them.
    """
    nulls = [F.col(c).isNull().alias(f"no_{c}") for c in ("host", "path")]
    keyed = sites.select(*(c for c in sites.columns if c not in ("host", "path")), *nulls, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"key_{c}") for c in ("host", "path")))
    left = docs.select("*", *nulls, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"key_{c}") for c in ("host", "path")))
    keys = ["key_host", "key_path", "no_host", "no_path"]
    small = sites.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    both = (left.join(F.broadcast(keyed), keys) if small else join_hot(left, keyed, keys)).drop(*keys)
    own, label = F.col("evidence"), F.col("good") if "good" in docs.columns else F.lit(None).cast("int")
    own_n = F.lit(1) + label.isNotNull().cast("int")

    def rest(level: str, centre: Column) -> Column:
        """The level's posterior rate from all but this document."""
        s = F.greatest(F.col(f"{level}_s") - own - F.coalesce(label, F.lit(0)), F.lit(0.0))
        n = F.greatest(F.col(f"{level}_n") - own_n, F.lit(0.0))
        return (s + F.col(f"{level}_strength") * centre) / (n + F.col(f"{level}_strength"))

    both = both.withColumn("host_rate", rest("host", F.col("global_rate")))
    both = both.withColumn("path_rate", F.least(F.greatest(rest("path", F.col("host_rate")), F.lit(1e-3)), F.lit(1 - 1e-3)))
    odds = _logit(own) + _logit(F.col("path_rate")) - _logit(F.col("global_rate"))
    return both.withColumn("score", 1 / (1 + F.exp(-odds))).drop("path_n", "path_s", "path_strength", "host_n", "host_s", "host_strength", "global_rate", "good")


def _found(docs: DataFrame, labels: DataFrame, host: Column, path: Column, model: QualityModel) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), host.alias("host"), path.alias("path"), evidence(docs, model).alias("evidence"))
    return cut(with_labels(rows, labels), "evidence")


def assess(docs: DataFrame, labels: DataFrame, host: Column, path: Column, model: QualityModel | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, host, path, evidence, host_rate, path_rate, score, keep for every document."""
    found = _found(docs, labels, host, path, model or fit(docs, labels))
    return combine(found, _posteriors(found)).withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5) -> DataFrame:
    """The documents that assess() keeps, with their own columns; evidence is made anew so that no text is shuffled."""
    model = fit(docs, labels)
    sites = _posteriors(_found(docs, labels, host, path, model))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(row, F.col("doc_id").cast("bigint").alias("doc_id"), host.alias("host"), path.alias("path"), evidence(docs, model).alias("evidence"))
    return combine(with_labels(own, labels), sites).filter(F.col("score") >= threshold).select("row.*")
