"""Toxicity scores from subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams, so a misspelling shares most of its vector
with the word it bends. A window of WINDOW words is the mean of their vectors (a repeat adds nothing, a missing word
counts as the zero vector), and a linear softmax makes its class scores.
A document is scored by its worst window, so a few toxic words in a long text aren't averaged away; in training, a
toxic document's windows count by how toxic the model takes them to be. Document scores are calibrated on the same rows.

Null texts and those without a word have no window and get 0. Repeated rows give repeated rows, an empty table none. A very
long text is scored whole, window by window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WordCache, drawn, held_out, lean, whole_texts

SCORED = "doc_id bigint, held_out boolean, score double, predicted int"
BITS, WIDTH, WINDOW = 17, 8, 16
#: Cut off a word's ends.
_EDGES = ".,;:!?\"'()[]{}<>*#%&$@/\\|-_~`+=«»„“”‘’…—–"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(embedding row, index of the word) of all character n-grams of 3 to 6 of each padded word, and of the word."""
    padded = ["\x02" + w.lower().strip(_EDGES) + "\x03" for w in words]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(padded)), lengths)
    rows, owners = [], []
    hashed = np.zeros(len(codes), np.uint64)
    for n in range(1, 7):
        m = len(codes) - n + 1
        if m <= 0:
            break
        hashed = (hashed[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93)
        if n >= 3:
            at = np.flatnonzero(owner[:m] == owner[n - 1 :])
            rows.append((hashed[at] ^ np.uint64(n)) >> np.uint64(64 - BITS))
            owners.append(owner[at])
    # words of one character, and the word itself
    spans = np.concatenate([[0], np.cumsum(lengths)])
    weight = np.uint64(0x2545F4914F6CDD1D) * (np.arange(len(codes)) - spans[owner] + 1).astype(np.uint64)
    mixed = (codes + np.uint64(3)) * (weight | np.uint64(1))
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    total = np.add.reduceat(mixed, spans[:-1]) if len(words) else np.zeros(0, np.uint64)
    rows.append((total * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS))
    owners.append(np.arange(len(words)))
    return np.concatenate(rows).astype(np.int64), np.concatenate(owners)


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of half-overlapping windows over n words."""
    starts = np.arange(0, max(n - WINDOW // 2, 1), WINDOW // 2)
    return starts, np.minimum(starts + WINDOW, n)


def first_in_window(ids: np.ndarray) -> np.ndarray:
    """1 for a word that none of the WINDOW - 1 words before it equals, else 0: repeats add nothing to a window."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    out = np.ones(len(ids))
    out[order[1:][same & (order[1:] - order[:-1] < WINDOW)]] = 0
    return out


@dataclass
class ToxicModel:
    #: each embedding row's share of the difference between the two classes' scores
    margin: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def word_margins(self, words: list[str]) -> np.ndarray:
        rows, owner = subwords(words)
        return np.bincount(owner, self.margin[rows], len(words)) / np.maximum(np.bincount(owner, minlength=len(words)), 1)

    def worst(self, ids: np.ndarray, margins: np.ndarray) -> float:
        """The highest class score of any window; ids: of words, margins: of each id."""
        if not len(ids):
            return -np.inf
        total = np.concatenate([[0.0], np.cumsum(margins[ids] * first_in_window(ids))])
        lo, hi = windows(len(ids))
        return float((total[hi] - total[lo]).max()) / WINDOW + self.bias

    def probability(self, worst):
        worst = np.asarray(worst, float)
        return np.where(np.isneginf(worst), 0.0, 1 / (1 + np.exp(-np.clip(self.scale * np.maximum(worst, -1e6) + self.shift, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and intercept of a one-variable logistic fit, classes weighted alike, by damped Newton steps."""
    w = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + 1e-3 * a, (w * (p - y)).sum()])
        h = w * p * (1 - p)
        m = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def train(texts: list[str], labels: list[int], epochs: int = 4, seed: int = 7, rate: float = 0.5) -> ToxicModel:
    """Embeddings and softmax together, by Adagrad on batches of windows.

    Texts without a word teach nothing; if the others are all of one class, every text with a word gets that class.
    """
    with_words = [k for k, t in enumerate(texts) if t and not t.isspace()]
    texts, labels = [texts[k] for k in with_words], [labels[k] for k in with_words]
    y_doc = np.asarray(labels)
    if len(set(labels)) < 2:
        return ToxicModel(np.zeros(1 << BITS), 0.0, 1.0, 4.0 if labels and labels[0] else -4.0)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in t.split()], np.int64) for t in texts]
    rows, owner = subwords(list(index))
    order = np.argsort(owner, kind="stable")
    rows, per_word = rows[order], np.bincount(owner, minlength=len(index))
    first = np.concatenate([[0], np.cumsum(per_word)])
    once = [first_in_window(d) for d in docs]
    spans = [(d, lo, hi) for d, words in enumerate(docs) if len(words) for lo, hi in zip(*windows(len(words)), strict=True)]
    doc_of = np.array([s[0] for s in spans])
    rng = np.random.default_rng(seed)
    emb = np.zeros((1 << BITS, WIDTH))  # an n-gram that training never met says nothing
    out = rng.normal(0, 0.5, (2, WIDTH))
    bias = np.zeros(2)
    sq_e, sq_o, sq_b = np.full(1 << BITS, 1e-3), np.full((2, WIDTH), 1e-3), np.full(2, 1e-3)
    y = y_doc[doc_of]
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    attention = np.ones(len(y))
    batch = min(512, max(16, len(y) // 24))  # two dozen steps an epoch at least
    epochs = max(epochs, -(-300 * batch // len(y)))  # and 300 in all
    for _ in range(epochs):
        scores = np.zeros(len(y))
        shuffled = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            at = shuffled[i : i + batch]
            words = np.concatenate([docs[spans[j][0]][spans[j][1] : spans[j][2]] for j in at])
            times = np.concatenate([once[spans[j][0]][spans[j][1] : spans[j][2]] for j in at])
            sizes = np.array([spans[j][2] - spans[j][1] for j in at])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            uniq, back = np.unique(words, return_inverse=True)
            n_sub = per_word[uniq]
            s0 = np.concatenate([[0], np.cumsum(n_sub)[:-1]])
            take = np.arange(n_sub.sum()) - np.repeat(s0, n_sub) + np.repeat(first[uniq], n_sub)
            sub = rows[take]
            vec = np.add.reduceat(emb[sub], s0) / n_sub[:, None]
            mean = np.add.reduceat(vec[back] * times[:, None], starts) / WINDOW
            z = mean @ out.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            scores[at] = z[:, 1] - z[:, 0]
            grad = p.copy()
            grad[np.arange(len(at)), y[at]] -= 1
            grad *= (weight[at] * attention[at])[:, None] / len(at)
            g_out, g_bias, g_mean = grad.T @ mean, grad.sum(0), grad @ out / WINDOW
            g_word = np.zeros((len(uniq), WIDTH))
            doc_row = np.repeat(np.arange(len(at)), sizes)
            for k in range(WIDTH):
                g_word[:, k] = np.bincount(back, g_mean[doc_row, k] * times, len(uniq))
            g_word /= n_sub[:, None]
            g_sub = np.repeat(g_word, n_sub, 0) * len(at)
            hit, where = np.unique(sub, return_inverse=True)
            total = np.stack([np.bincount(where, g_sub[:, k], len(hit)) for k in range(WIDTH)], 1)
            sq_e[hit] += (total**2).mean(1)
            emb[hit] -= rate * total / np.sqrt(sq_e[hit])[:, None]
            sq_o += g_out**2
            out -= 0.1 * rate * g_out / np.sqrt(sq_o)
            sq_b += g_bias**2
            bias -= 0.1 * rate * g_bias / np.sqrt(sq_b)
        top = np.full(len(docs), -np.inf)
        np.maximum.at(top, doc_of, scores)
        attention = np.where(y == 1, np.exp(np.clip(scores - top[doc_of], -20, 0)), 1.0)
    model = ToxicModel(emb @ (out[1] - out[0]), float(bias[1] - bias[0]))
    margins = np.add.reduceat(model.margin[rows], first[:-1]) / np.maximum(per_word, 1)
    worst = np.array([model.worst(d, margins) for d in docs])
    some = ~np.isneginf(worst)
    if len(set(y_doc[some])) == 2:
        model.scale, model.shift = _logistic(worst[some], y_doc[some])
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000, most_bytes: int = 64_000_000) -> ToxicModel:
    """Learns from about `per_class` whole labelled documents of each class outside the held-out fold, chosen by a hash.

    Of several labels of a doc_id the highest counts, of several texts the least; most_bytes bounds the texts in all.
    """
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    some = F.lit(False)
    for value, n in sizes.items():
        some = F.when(F.col("toxic") == value, drawn(F.col("doc_id"), per_class, n)).otherwise(some)
    chosen = known.filter(some)  # about per_class rows a class, so it can be broadcast
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").alias("label"))
    found = whole_texts(rows, most_bytes)
    return train([r["text"] for r in found], [int(r["label"] > 0) for r in found])


class Scorer:
    def __init__(self, model: ToxicModel, most_words: int = 300_000):
        self.model, self.most = model, most_words
        self.index = WordCache(self._next, 1 << 62)
        self.margins = np.zeros(0)
        self.new: list[str] = []

    def _next(self, word: str) -> int:
        self.new.append(word)
        return len(self.margins) + len(self.new) - 1

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.margins) > self.most:
            self.index.clear()
            self.margins = self.margins[:0]
        index = self.index
        ids = [[index[w] for w in t.split()] if t else [] for t in texts]
        if self.new:
            self.margins = np.concatenate([self.margins, *(self.model.word_margins(self.new[i : i + 8192]) for i in range(0, len(self.new), 8192))])
            self.new = []
        return self.model.probability([self.model.worst(np.asarray(x, np.int64), self.margins) for x in ids])


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS doubles

    def rate(batches):
        found = Scorer(shared.value)
        for batch in batches:
            p = found(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(lean(rate), SCORED)
