"""Best-fit packing of tokenised documents into fixed-length training sequences.

Lengths live in a histogram of at most `capacity` classes, so the whole packing plan is made from that histogram:
exact complements (one, two or three lengths that fill a gap to the token) are consumed first, each under the counts
still available, and what is left is placed best fit, longest first. The plan maps (length, rank within the length) to
a sequence and an offset; the ranks are made by Spark with salted counts, so a length that holds most pieces is spread.

Nulls: a null text is an empty document (just the separator id); a null doc_id is kept. Repeated rows are packed as
often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Cut, cut, lean, partitions

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"

#: White space of the Unicode standard; str.split() without arguments also splits at U+001C to U+001F.
_SPLITS_MORE = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")


#: Below this character all libraries agree on letters, digits and lower case.
_PLAIN = "\u0250"
#: How the tokenizers file splits normalised text.
_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Stands for the end of a word behind its bytes; no UTF-8 text holds it.
_END = b"\xff"


def _byte_letters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _piece_encoder(tokenizer):
    """(function from a pre-token's bytes and _END to ranks, the ids of the ranks), by the same merges in tiktoken.

    tiktoken merges two neighbours whenever they make a token, the file only by its list of pairs. The two agree if
    every merge makes a token of its own and the file encodes every token's text as that token: two neighbours that
    make a token, but not by its pair, would otherwise be how the file leaves that token's text. (None, None) if that
    doesn't hold for the file.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    model = json.loads(tokenizer.to_str())["model"]
    vocabulary, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    letters = _byte_letters()
    joined = [a + b for a, b in merges]
    base = [c for c in letters if c in vocabulary and c + "</w>" in vocabulary]
    if len(base) != 256 or len(set(joined)) != len(joined) or any(t not in vocabulary for t in joined) or model.get("end_of_word_suffix") != "</w>":
        return None, None
    alone = Tokenizer(tokenizer.model)
    if any(alone.encode(t.removesuffix("</w>")).ids != [vocabulary[t]] for t in joined if t.endswith("</w>")):
        return None, None
    # a token within a word can't be asked for alone: its merges must lead to it from its letters
    rank = {pair: k for k, pair in enumerate(merges)}
    for t in joined:
        if not t.endswith("</w>"):
            parts = list(t)
            while len(parts) > 1:
                k = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), len(rank)))
                if (parts[k], parts[k + 1]) not in rank:
                    return None, None
                parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def raw(token: str) -> bytes:
        return bytes(letters[c] for c in token.removesuffix("</w>")) + (_END if token.endswith("</w>") else b"")

    order = sorted(base, key=letters.get)
    tokens = [*order, *(c + "</w>" for c in order), *joined]
    ranks = {raw(t): k for k, t in enumerate(tokens)}
    if len(ranks) != len(tokens):
        return None, None
    coder = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    return coder._core_bpe.encode_single_piece, np.array([vocabulary[t] for t in tokens], "<u4")


class WordEncoder:
    """Ids of whole texts by a tokenizers file whose pre-tokens never span white space.

    The ids of words met at least twice are kept as bytes. New plain words are split as the file says and their
    pre-tokens merged by the file's list; other words, and texts with special tokens, go through the file one by one.
    """

    def __init__(self, path: str, most: int = 300_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.split, self.most = Tokenizer.from_file(path), regex.compile(_PRETOKEN), most
        self.pieces, self.numbers = _piece_encoder(self.tokenizer)
        self.words: dict[str, bytes] = {}
        self.marks = {x: self.pieces(x.encode() + _END) for x in ".,;:!?"} if self.pieces else {}
        self.met = bytearray(1 << 23)

    def forget(self) -> None:
        self.words = {}

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """The ids of new words; those met before are kept."""
        out: dict[str, bytes] = {}
        names, flat, ends = [], [], []
        code, marks = self.pieces, self.marks
        for w in new:
            if code is None or not (w.isascii() or max(w) < _PLAIN):
                out[w] = self.ids(w)
                continue
            low = w.lower()
            if low.isalpha():
                flat += code(low.encode() + _END)
            elif low[-1] in marks and low[:-1].isalpha():
                flat += code(low[:-1].encode() + _END)
                flat += marks[low[-1]]
            else:
                for x in self.split.findall(low):
                    flat += code(x.encode() + _END)
            names.append(w)
            ends.append(4 * len(flat))
        if names:
            raw = self.numbers[np.asarray(flat, np.int64)].tobytes()
            out.update(zip(names, [raw[x:y] for x, y in zip([0, *ends], ends, strict=False)], strict=True))
        words, met, mask = self.words, self.met, len(self.met) - 1
        if len(words) > self.most:
            words.clear()
        for w, ids in out.items():
            k = hash(w) & mask
            if met[k]:
                words[w] = ids
            met[k] = 1
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split: list[list[str] | None] = []
        for text in texts:
            if any(x in text for x in _SPLITS_MORE) or "<|" in text and any(x in text for x in _SPECIAL):
                split.append(None)
            else:
                split.append((text if text.isascii() else unicodedata.normalize("NFC", text)).split())
        get = self.words.get
        found = [None if words is None else list(map(get, words)) for words in split]
        new = {w for words, got in zip(split, found, strict=True) if got for w, x in zip(words, got, strict=True) if x is None}
        if new:
            fresh = self._learn(new)
            found = [None if got is None else [x if x is not None else fresh[w] for w, x in zip(words, got, strict=True)] for words, got in zip(split, found, strict=True)]
        return [self.ids(text) if got is None else b"".join(got) for text, got in zip(texts, found, strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """Token pieces of every document: its ids, then `separator`, cut every `capacity` ids."""
    width, end = 4 * capacity, np.asarray([separator], "<u4").tobytes()

    def cut_up(batches):
        encode = encoder(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            coded = encode([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, own in zip(batch.column(0).to_pylist(), coded, strict=True):
                ids = own + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encode.forget()  # the worker lives on for other stages

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(cut_up), PIECES)


# --- the plan -------------------------------------------------------------------------------------------------------


class SumIndex:
    """Single lengths, pairs and triples of the lengths that occur, by their sum; each sum's combinations the most even first.

    A pair is kept by its longer length, a triple by its longest one, whose rest is a sum in the index of pairs.
    """

    def __init__(self, have: np.ndarray):
        top = len(have) - 1
        lengths = np.flatnonzero(have)
        longer, shorter = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
        real = (longer >= shorter) & (longer + shorter <= top)
        self.longer, self.pair_edges = self._by_sum(longer[real], (longer + shorter)[real], top)
        sums = np.flatnonzero(np.diff(self.pair_edges))
        longest, rest = (x.ravel() for x in np.meshgrid(lengths, sums, indexing="ij"))
        real = (longest + rest <= top) & (2 * longest >= rest)
        self.longest, self.triple_edges = self._by_sum(longest[real], (longest + rest)[real], top)

    @staticmethod
    def _by_sum(length: np.ndarray, total: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((length, total))
        return length[order], np.searchsorted(total[order], np.arange(top + 2))

    def pair(self, total: int, have: np.ndarray, most: int) -> tuple[int, ...]:
        a = self.longer[self.pair_edges[total] : self.pair_edges[total + 1]]
        a = a[: np.searchsorted(a, most, "right")]
        ok = np.flatnonzero((have[a] > 0) & (have[total - a] > (2 * a == total)))
        return (int(a[ok[0]]), int(total - a[ok[0]])) if len(ok) else ()

    def find(self, gap: int, have: np.ndarray) -> tuple[int, ...]:
        """Up to three available lengths, longest first, that add up to gap; () if there are none.

        Of several pairs or triples the most even one is taken: short lengths stay for gaps that nothing else fills. A
        combination may use a length as often as it is available.
        """
        if have[gap] > 0:
            return (gap,)
        if found := self.pair(gap, have, gap):
            return found
        firsts = self.longest[self.triple_edges[gap] : self.triple_edges[gap + 1]]
        for first in firsts[have[firsts] > 0].tolist():
            have[first] -= 1
            rest = self.pair(gap - first, have, first)
            have[first] += 1
            if rest:
                return first, *rest
        return ()


def plan(counts: dict[int, int], capacity: int = 2048) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, their lengths in order), for all pieces of the histogram."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] += n
    out: list[tuple[int, tuple[int, ...]]] = []
    if have[capacity]:
        out.append((int(have[capacity]), (capacity,)))
        have[capacity] = 0
    index = SumIndex(have)
    for length in range(capacity - 1, 0, -1):
        while have[length] > 0:
            have[length] -= 1  # the one whose gap is filled
            found = index.find(capacity - length, have)
            have[length] += 1
            if not found:
                break
            shape = (length, *found)
            need: dict[int, int] = defaultdict(int)
            for x in shape:
                need[x] += 1
            times = min(int(have[x]) // k for x, k in need.items())
            for x, k in need.items():
                have[x] -= times * k
            out.append((times, shape))
    return out + _best_fit(have, capacity)


def _best_fit(have: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, longest first; bins with equal contents are handled together."""
    bins: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    gaps: list[int] = []

    def put(n: int, shape: tuple[int, ...], gap: int) -> None:
        if gap not in bins or not bins[gap]:
            i = bisect.bisect_left(gaps, gap)
            if i == len(gaps) or gaps[i] != gap:
                gaps.insert(i, gap)
        bins[gap].append((n, shape))

    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left:
            i = bisect.bisect_left(gaps, length)
            if i < len(gaps):
                gap = gaps[i]
                n, shape = bins[gap].pop()
                if not bins[gap]:
                    gaps.pop(i)
                m = min(n, left)
                if n > m:
                    put(n - m, shape, gap)
                put(m, (*shape, length), gap - length)
                left -= m
            else:
                k = min(left, capacity // length)
                n = left // k
                put(n, (length,) * k, capacity - k * length)
                left -= n * k
    return [x for gap in gaps for x in bins[gap]]


def placements(the_plan: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each run of ranks, the sequence of that rank, the offset in the sequence."""
    used: dict[int, int] = defaultdict(int)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for n, shape in the_plan:
        at = 0
        for length in shape:
            runs[length].append((used[length], first, at))
            used[length] += n
            at += length
        first += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


# --- the operator ---------------------------------------------------------------------------------------------------


def ranked(found: DataFrame, salts: int) -> DataFrame:
    """`rank` (from 0) of every row among those of its length, by salted counts: no length is gathered in one task."""
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    return salted.withColumn("at", F.row_number().over(within) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("at")).drop("salt", "before", "at")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    spark = docs.sparkSession
    found = cut(pieces(docs, tokenizer_path, capacity, separator), "pieces")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    spots = spark.sparkContext.broadcast(placements(plan(histogram, capacity)))  # bounded by the number of length classes and shapes, not by rows
    rows = Cut(ranked(found, 4 * partitions(spark)), "ranks").df

    def place(batches):
        where = spots.value
        for batch in batches:
            lengths, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                first, sequence, offset = where[int(length)]
                run = np.searchsorted(first, ranks[at], "right") - 1
                seq[at], off[at] = sequence[run] + ranks[at] - first[run], offset[run]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return rows.mapInArrow(place, PACKED)
