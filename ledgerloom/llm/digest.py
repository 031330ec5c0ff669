"""Quartile bucket digests of byte triplets, and what an edit to a document does to them.

Hashed triplets from a sliding window of five bytes are counted in 256 buckets. A digest holds a checksum, a logarithm
of the length, two quartile ratios, and for each bucket the quartile (two bits) that its count lies in. Two digests
differ by a score of at most BOUND, so likeness = 1 - score / BOUND lies in 0 to 1.

Null texts are empty; texts under three bytes count no triplet. The next document is the next in order of doc_id (null
ids last), rows with one id in order of text; after the last comes the first, also if no row has an id. Repeated rows are
rows of their own; an empty table gives an empty one. Very long texts are counted whole, block by block. Rows of one
doc_id, and those without one, are dealt out by their texts' first bytes; those with the same are ordered by one task.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import lean, partitions

BUCKETS = 256
BOUND = 640
#: Places in the five-byte window of each triplet counted.
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
FINGERPRINTED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_BLOCK = 1 << 18


def triplet_counts(raw: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(raw) - 2, 0), _BLOCK):
        b = np.frombuffer(raw, np.uint8, min(_BLOCK + 4, len(raw) - at), at).astype(np.uint32)
        starts = min(_BLOCK, len(raw) - at)
        for k, (i, j, l) in enumerate(_TRIPLETS):
            m = min(starts, len(b) - l)
            if m > 0:
                h = b[i : i + m] * np.uint32(0x9E3779B1) + b[j : j + m] * np.uint32(0x85EBCA77) + b[l : l + m] * np.uint32(0xC2B2AE3D) + np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def fingerprint(raw: bytes) -> str:
    """134 hex digits: checksum, length, ratios, buckets."""
    counts = triplet_counts(raw)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    ratios = (int(q1 * 16 // max(q3, 1)) % 16) << 4 | int(q2 * 16 // max(q3, 1)) % 16
    length = min(255, round(12 * math.log2(len(raw) + 1))) if raw else 0
    check = hashlib.blake2b(raw, digest_size=1).digest()[0]
    return bytes([check, length, ratios]).hex() + body.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """0 (alike) to BOUND."""
    x, y = (np.frombuffer(bytes.fromhex(v), np.uint8).astype(np.int16) for v in (a, b))
    codes = np.abs(np.stack([(x[3:] >> s & 3) - (y[3:] >> s & 3) for s in (0, 2, 4, 6)]))
    body = int(codes.sum()) + 3 * int((codes == 3).sum())
    length = max(0, abs(int(x[1]) - int(y[1])) - 1) * 2
    ratio = sum(max(0, abs(int(x[2] >> s & 15) - int(y[2] >> s & 15)) - 1) * 2 for s in (0, 4))
    return min(BOUND, body + length + ratio + int(x[0] != y[0]))


def likeness(a: str, b: str) -> float:
    return 1 - difference(a, b) / BOUND


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) of the code points replaced by as many, or all, of the next text's first."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


_ROW = pa.schema([("bucket", pa.int32()), ("guest", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("fingerprint", pa.string())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


#: Bytes at a text's beginning by which the rows of one doc_id are dealt out: their number is exact as a double.
_HEAD = 6


def head(raw: bytes) -> int:
    """The first bytes as a number, in the order of texts."""
    return int.from_bytes(raw[:_HEAD].ljust(_HEAD, b"\0"), "big")


class Ranges:
    """Ranges of (doc_id, text) that hold about as many rows each; none is empty, and rows without an id come last.

    A range begins with a doc_id or, where rows of one doc_id (or without one) fill several, with a head of their texts.
    """

    def __init__(self, base: DataFrame, ranges: int):
        marks = [k / ranges for k in range(1, ranges)]
        found = base.agg(F.percentile_approx("doc_id", marks, F.lit(20 * ranges)).alias("q"), F.min("doc_id").alias("first"), F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
        self.first = found["first"]
        starts = Counter(found["q"] or [])
        if any(abs(x) >= 2**53 for x in starts):  # quantiles are doubles: take the first real id from each on
            real = self._real(base, np.array(sorted(starts), np.int64))
            starts = Counter({real[x]: k for x, k in starts.items() if x in real})
        self.ids = np.array(sorted({self.first, *starts} - {None}), np.int64)
        nulls = (found["n"] - found["named"]) * ranges // max(found["n"], 1)
        hot = {x: k for x, k in starts.items() if k > 1} | ({None: nulls} if nulls > 1 else {})
        self.heads: dict[int | None, list[int]] = {}
        if hot:
            as_number = F.conv(F.rpad(F.substring(F.hex(F.encode("text", "utf-8")), 1, 2 * _HEAD), 2 * _HEAD, "0"), 16, 10).cast("bigint")
            some = F.col("doc_id").isin([x for x in hot if x is not None])
            rows = base.filter(some | F.col("doc_id").isNull() if None in hot else some).select("doc_id", as_number.alias("head"))
            most = max(hot.values())
            for r in rows.groupBy("doc_id").agg(F.min("head").alias("least"), F.percentile_approx("head", [k / most for k in range(1, most)], F.lit(20 * most)).alias("q")).collect():  # at most `ranges` rows
                self.heads[r["doc_id"]] = sorted({x for x in r["q"] if x > r["least"]})
        sizes = [1 + len(self.heads.get(int(x), ())) for x in self.ids]
        self.begin = np.concatenate([[0], np.cumsum(sizes)]).astype(int)  # of each id's ranges, and of those without an id
        self.last = int(self.begin[-1]) + (len(self.heads.get(None, ())) if found["named"] < found["n"] else -1)

    @staticmethod
    def _real(base: DataFrame, marks: np.ndarray) -> dict[int, int]:
        """Of each mark the least id from it up to the next one, where there is any."""

        def least(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy()
                k = np.searchsorted(marks, ids, "right") - 1
                ids, k = ids[k >= 0], k[k >= 0]
                own, where = np.unique(k, return_inverse=True)
                low = np.full(len(own), np.iinfo(np.int64).max)
                np.minimum.at(low, where, ids)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(low)], names=["k", "id"])

        found = base.filter("doc_id is not null").select("doc_id").mapInArrow(least, "k bigint, id bigint").groupBy("k").agg(F.min("id").alias("id")).collect()  # a row a mark
        return {int(marks[r["k"]]): r["id"] for r in found}

    def of(self, doc_id: int | None, raw: bytes) -> tuple[int, bool]:
        """(range of a row, whether it may be the first there: it has the id, or the head, that the range begins with)."""
        if doc_id is None:
            own, starts = int(self.begin[-1]), True
        else:
            k = int(np.searchsorted(self.ids, doc_id, "right")) - 1
            if self.ids[k] != doc_id:  # behind the id that its last range begins with
                return int(self.begin[k + 1]) - 1, False
            own, starts = int(self.begin[k]), True
        heads = self.heads.get(doc_id)
        if not heads:
            return own, starts
        at = head(raw)
        j = bisect_right(heads, at)
        return own + j, j == 0 or heads[j - 1] == at


def fingerprints(docs: DataFrame) -> DataFrame:
    """Digest of every text and of its edited text. Texts are shuffled once, by ranges of doc_id (and text, of hot ids).

    Each range also gets the first row of the next one, as a guest that only serves as a follower.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = Ranges(base, min(8 * n, 4096))

    def spread(batches):
        least: dict[int, str] = {}  # of the texts that may be first in a range, the least that this task has met
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                own, may_lead = ranges.of(doc_id, raw)
                digest = fingerprint(raw)
                out.append((own, 0, doc_id, text, digest))
                if may_lead and (own not in least or text < least[own]):
                    least[own] = text
                    out.append((own - 1 if own else ranges.last, 1, doc_id, text, digest))
            yield _batch(out, _ROW)

    def follow(batches):
        held = None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held is not None and not held[1]:
                    out.append(judge(held, row if row[0] == held[0] else None))
                held = row
            yield _batch(out, _OUT)
        if held is not None and not held[1]:
            yield _batch([judge(held, None)], _OUT)

    def judge(row, following):
        _, _, doc_id, text, digest = row
        after, after_digest = (following[3], following[4]) if following else ("", fingerprint(b""))
        new = edited(text, after).encode("utf-8", "surrogatepass")
        new_digest = fingerprint(new)
        return doc_id, len(text), hashlib.sha256(new).hexdigest(), digest, new_digest, likeness(digest, new_digest), likeness(digest, after_digest)

    rows = base.mapInArrow(lean(spread), "bucket int, guest int, doc_id bigint, text string, fingerprint string")
    dealt = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_last(), "text")
    return dealt.mapInArrow(lean(follow), FINGERPRINTED)
