"""Language identification of texts that mix languages.

A document is a bag of words, each drawn whole from one language; a word's likelihood in a language comes from its
character n-grams. Expectation-maximisation estimates the document's language proportions. Sets of 1, 2, ... languages,
nested by proportion, are fitted in turn, and the set with the best likelihood less a penalty per further language is
kept; its most frequent language is the prediction.

Nulls and texts without a letter get `und` with score 0. Ties go to the language that sorts first. A null language is
never learned from. Repeated rows give repeated rows; an empty table gives none, and without any learned language every
text is `und`. A very long text is inferred from all its words. The model that each task gets is a table of 2 ** BITS
floats a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WordCache, drawn, held_out, lean, trim, whole_texts

PREDICTED = "doc_id bigint, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>"
#: Tables of n-gram likelihoods have 2 ** BITS rows, one column a language.
BITS = 17
UNKNOWN = "und"


def ngram_rows(words: list[str], sizes: tuple[int, ...] = (1, 2, 3, 4)) -> tuple[np.ndarray, np.ndarray]:
    """(table row, index of the word) of every character n-gram of every padded word."""
    codes = np.frombuffer("\x01".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edge = codes == 1
    word = np.cumsum(edge) - 1
    rows, owners = [], []
    hashed = np.zeros(len(codes), np.uint64)
    for n in range(1, max(sizes) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        hashed = (hashed[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        if n in sizes:
            # within one word: no edge but at the first or last place
            inner = np.zeros(m, bool) if n < 3 else np.add.reduce([edge[i : i + m] for i in range(1, n - 1)]).astype(bool)
            ok = ~inner & ~(edge[:m] & edge[n - 1 :]) if n > 1 else ~edge
            at = np.flatnonzero(ok)
            rows.append(((hashed[at] ^ np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(word[at])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(owners)


def words_of(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class LanguageModel:
    langs: list[str]
    #: log likelihood of each n-gram row in each language, float32 [2 ** BITS, languages]
    table: np.ndarray
    #: each further language of a document must gain as many nats
    penalty: float = 12.0
    #: log likelihood of each n-gram row in no learned language, on the scale of `table`, float32 [2 ** BITS]
    unknown: np.ndarray | None = None

    def word_logs(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word in each language and, last, in none: the mean of its n-grams' times the root of their number."""
        rows, owner = ngram_rows(words)
        k = len(self.langs)
        out = np.zeros((len(words), k + 1))
        n = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        for j in range(k):
            out[:, j] = np.bincount(owner, self.table[rows, j], len(words))
        out[:, k] = -np.inf if self.unknown is None else np.bincount(owner, self.unknown[rows], len(words))
        return out / np.sqrt(n)[:, None]


def learn(texts: list[str], langs: list[str]) -> LanguageModel:
    names = sorted(set(langs))
    counts = np.zeros((1 << BITS, max(len(names), 1)))
    for k, name in enumerate(names):
        own = [t for t, x in zip(texts, langs, strict=True) if x == name]
        for i in range(0, len(own), 200):
            seen: dict[str, int] = {}
            for text in own[i : i + 200]:
                for w in words_of(text):
                    seen[w] = seen.get(w, 0) + 1
            rows, owner = ngram_rows(list(seen))
            times = np.fromiter(seen.values(), float, len(seen))
            counts[:, k] += np.bincount(rows, times[owner], 1 << BITS)
    used = counts.any(1).sum() + 1
    table = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * used))
    top = table.max(1)
    return LanguageModel(names, (table - top[:, None]).astype(np.float32), unknown=(unknown_level(counts, table, used) - top).astype(np.float32))


def unknown_level(counts: np.ndarray, table: np.ndarray, used: float) -> float:
    """Log likelihood of an n-gram in no learned language.

    Halfway between a language's n-grams in their own language and in the learned one that fits them least, as text in an
    unlearned language would; a nat below their own at least, should the learned ones be alike.
    """
    each = counts.T @ table / np.maximum(counts.sum(0), 1)[:, None]  # of row k's n-grams in column j
    own = np.diag(each)
    other = each.min(1) if len(each) > 1 else np.array([-np.log(used)])
    return float(np.minimum((own + other) / 2, own - 1).mean())


def _expect(logs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after `rounds` of EM from `shares` (languages at 0 stay out) and the documents' log likelihoods."""
    top = logs.max(1)
    like = np.exp(logs - top[:, None])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for _ in range(rounds):
        each = like * shares[doc]
        each /= np.maximum(each.sum(1), 1e-300)[:, None]
        shares = np.add.reduceat(each, starts) / sizes[:, None]
    total = np.log(np.maximum((like * shares[doc]).sum(1), 1e-300)) + top
    return shares, np.add.reduceat(total, starts)


def infer(model: LanguageModel, logs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Proportions of each document (rows of logs, document after document; all sizes > 0) over its chosen set."""
    n, k = len(sizes), len(model.langs)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    whole = np.add.reduceat(logs, starts)
    best = whole.argmax(1)
    value = whole[np.arange(n), best]
    chosen = np.zeros((n, k))
    chosen[np.arange(n), best] = 1
    if k == 1:
        return chosen
    full, _ = _expect(logs, starts, sizes, np.full((n, k), 1 / k), 6)
    order = np.argsort(-full, 1, kind="stable")
    doc = np.repeat(np.arange(n), sizes)
    active = np.flatnonzero(full[np.arange(n), order[:, 1]] > 0.01)
    for size in range(2, k + 1):
        if not len(active):
            break
        keep = np.zeros((len(active), k))
        np.put_along_axis(keep, order[active, :size], 1.0, 1)
        mask = np.zeros(n, bool)
        mask[active] = True
        some, own = logs[mask[doc]], sizes[active]
        first = np.concatenate([[0], np.cumsum(own)[:-1]])
        begin = keep * np.maximum(full[active], 1e-3)
        shares, like = _expect(some, first, own, begin / begin.sum(1, keepdims=True), 6)
        like = like - model.penalty * (size - 1)
        won = like > value[active]
        value[active[won]], chosen[active[won]] = like[won], shares[won]
        active = active[full[active, order[active, min(size, k - 1)]] > 0.01]
    return chosen


def known_shares(model: LanguageModel, logs: np.ndarray, sizes: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The proportions of `infer` with words in no learned language counted among all, so that they can sum to less than 1.

    `logs` has the column of no language too. As a further language, it must gain the penalty.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    _, value = _expect(logs[:, :-1], starts, sizes, shares, 0)
    begin = np.concatenate([0.9 * shares, np.full((len(sizes), 1), 0.1)], 1)
    found, like = _expect(logs, starts, sizes, begin, 6)
    return np.where((like - model.penalty > value)[:, None], found[:, :-1], shares)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Predictor:
    def __init__(self, model: LanguageModel, most_words: int = 200_000):
        self.model = model
        self.index = WordCache(self._next, 1 << 62)
        self.most = most_words
        self.logs = np.zeros((0, len(model.langs) + 1))
        self.new: list[str] = []

    def _next(self, word: str) -> int:
        self.new.append(word)
        return len(self.logs) + len(self.new) - 1

    def _look_up(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(places of the texts with a letter, their words' logs one after the other, their numbers of words)."""
        real = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.model.langs else []
        if not real:
            return real, self.logs[:0], np.zeros(0, np.int64)
        if len(self.logs) > self.most:
            self.index.clear()
            self.logs = self.logs[:0]
        index = self.index
        ids = [[index[w] for w in words_of(texts[i])] for i in real]
        if self.new:
            self.logs = np.concatenate([self.logs, *(self.model.word_logs(self.new[i : i + 8192]) for i in range(0, len(self.new), 8192))])
            self.new = []
        return real, self.logs[np.concatenate([np.asarray(x, np.int64) for x in ids])], np.array([len(x) for x in ids])

    def main_shares(self, texts: list[str | None]) -> np.ndarray:
        """The main language's share of each text's words, those in no learned language among them."""
        out = np.zeros(len(texts))
        real, logs, sizes = self._look_up(texts)
        if real:
            out[real] = known_shares(self.model, logs, sizes, infer(self.model, logs[:, :-1], sizes)).max(1)
        return out

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, list[str], list[float]]]:
        out = [(UNKNOWN, 0.0, [], [])] * len(texts)
        real, logs, sizes = self._look_up(texts)
        if not real:
            return out
        shares = infer(self.model, logs[:, :-1], sizes)
        langs = self.model.langs
        for i, row in zip(real, shares, strict=True):
            k = int(row.argmax())
            order = [int(j) for j in np.argsort(-row, kind="stable") if row[j] > 0]
            out[i] = (langs[k], float(min(1.0, row[k])), [langs[j] for j in order], [float(row[j]) for j in order])
        return out


def fit(docs: DataFrame, per_language: int = 1500, most_bytes: int = 96_000_000) -> LanguageModel:
    """Learns from about `per_language` whole documents of each language outside the held-out fold, chosen by a hash.

    Of several rows of a doc_id the least text counts, once; most_bytes bounds the texts in all.
    """
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    some = F.lit(False)
    for lang, n in sizes.items():
        some = F.when(F.col("lang") == lang, drawn(F.col("doc_id"), per_language, n)).otherwise(some)
    rows = known.filter(some).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").alias("label"))
    found = whole_texts(rows, most_bytes)
    return learn([r["text"] for r in found], [r["label"] for r in found])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS rows of a float a language

    def label(batches):
        find = Predictor(shared.value)
        for batch in batches:
            found = find(batch.column(2).to_pylist())
            cols = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.list_(pa.float64()))],
                names=["doc_id", "held_out", "lang_pred", "score", "languages", "proportions"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(lean(label), PREDICTED)


def keep_identified(docs: DataFrame, model: LanguageModel, least_share: float) -> DataFrame:
    """The documents, with their own columns, whose main language has at least `least_share` of their words.

    Words in no learned language count among them, so text in an unlearned language or letter junk goes too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def main_share(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = Predictor(shared.value)
        for text in texts:
            yield pd.Series(find.main_shares(text.tolist()), dtype="float64")
        trim()

    return docs.filter(main_share(F.col("text").cast("string")) >= max(least_share, 1e-9))
