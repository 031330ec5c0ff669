"""Removal of long byte strings that an earlier document has too, by a logarithmic family of suffix arrays.

Every 50-byte string (a suffix cut to depth 50) starts in exactly one run of neighbouring strings with one minimiser, so
runs are dealt to buckets by that minimiser's hash and equal strings meet in one bucket, wherever they come from. A
bucket takes its runs in batches of ascending doc_id. A batch gets a suffix array, the places of its distinct strings in
the order of their bytes; this is merge-scanned against the levels that hold the strings of earlier batches, and what
they lack becomes a level itself. Levels of equal size merge, so a bucket keeps a logarithmic number of them. With an
index folder the levels are stored there, and later calls scan their documents against them and add to them. Strings
are told apart by their bytes; hashes only deal runs to buckets, propose runs that may be equal, and, where no later
call will ask, leave strings out of the arrays that nothing in the bucket can equal.

Copies of a run that a task meets together are settled there and sent once, and those of runs that many documents have
only for ids below all before, so what a bucket gets of a passage grows with the number of tasks, not with its copies. Texts and what was found of them meet in streams sorted by home.

Strings are judged on the input. Nulls: a null text is empty; a document with a null doc_id neither loses bytes nor
makes others lose any. Rows that share a doc_id don't make each other lose bytes, and each row loses its own text's
bytes; a repeated row loses the same as the first. Texts under 50 bytes stay whole. An empty table gives an empty one.
Long texts are cut into blocks of strings, which changes no result. Columns with other names than doc_id and text are
never read, whatever they are called.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .base import cut, lean, partitions

DEPTH, SEED_BYTES = 50, 12
#: Seeds in a window: every string of DEPTH bytes holds so many.
_SEEDS = DEPTH - SEED_BYTES + 1
#: Long texts are cut into blocks of so many strings, so that places fit the low bits of a packed seed.
_BLOCK, _PLACE = 1 << 18, 20
#: Bytes of text that a task gathers before it sends its runs, and runs of an index batch.
_FLUSH, _BATCH_RUNS = 4_000_000, 1 << 14
#: Documents of one gathering from which a run is remembered for the next ones, and runs that are, at most.
_MANY, _MOST_SEEN = 8, 100_000
#: Repeated doc_ids at most that are joined by broadcast; beyond, by a shuffled join.
MOST_BROADCAST = 1_000_000
DEDUPED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

_NEVER = np.iinfo(np.int64).max
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words8(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as big-endian numbers."""
    x = raw.astype(np.uint64)
    for n in (1, 2, 4):
        wide = x[:-n] << np.uint64(8 * n)
        wide |= x[n:]
        x = wide
    return x


def runs(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket hash, document, place in the text, number of strings) of every run of strings with one minimiser.

    text: documents one after the other, document k from starts[k] to ends[k]; a string lies in one document.
    """
    parts = []
    cuts = np.unique(np.concatenate([starts, np.maximum(ends - DEPTH + 1, starts)]))  # where strings of a document begin and cease
    for at in range(0, max(len(text) - DEPTH + 1, 0), _BLOCK):
        block = text[at : at + _BLOCK + DEPTH - 1]
        x = words8(block)
        m = len(block) - SEED_BYTES + 1
        key = x[:m] * _K[0] ^ (x[SEED_BYTES - 8 : SEED_BYTES - 8 + m] * _K[1])
        key ^= key >> np.uint64(29)
        key *= _K[2]
        key = (key >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(m, dtype=np.uint64)
        least, n = key, 1
        while 2 * n <= _SEEDS:
            least, n = np.minimum(least[:-n], least[n:]), 2 * n
        if n < _SEEDS:
            least = np.minimum(least[: len(least) - (_SEEDS - n)], least[_SEEDS - n :])
        new = np.concatenate([[True], least[1:] != least[:-1]])
        new[cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, at + len(least))] - at] = True
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(least)))
        doc = np.searchsorted(starts, first + at, "right") - 1
        own = np.flatnonzero(first + at + DEPTH <= ends[doc])
        first, doc = first[own], doc[own]
        parts.append((((least[first] >> np.uint64(_PLACE)) & np.uint64(0xFFFFFFFF)).astype(np.uint32), doc, first + at, size[own]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint32), none, none, none
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def spread(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of each run, run after run."""
    return np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)


def same_runs(text: np.ndarray, at: np.ndarray, wide: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each kind, kind of each run): runs of one kind have equal bytes, by a hash and then their bytes."""
    x = sliding_window_view(text, 8)

    def word(place):
        return x[place].view(">u8").ravel()

    key = (h.astype(np.uint64) << np.uint64(8)) ^ wide.astype(np.uint64)
    for k in range(0, int(wide.max(initial=8)), 8):
        key = (key ^ word(at + np.minimum(k, wide - 8)).astype(np.uint64)) * _K[k // 8 % 4]
        key ^= key >> np.uint64(31)
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[kind] != np.arange(len(at)))
    model = first[kind[again]]
    other = (wide[again] != wide[model]) | (h[again] != h[model])
    for k in range(0, int(wide.max(initial=8)), 8):
        other |= word(at[again] + np.minimum(k, wide[again] - 8)) != word(at[model] + np.minimum(k, wide[model] - 8))
    apart = again[other]  # one hash, other bytes
    kind[apart] = len(first) + np.arange(len(apart))
    return np.concatenate([first, apart]), kind


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=6).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


#: What the rows for a bucket hold.
_LEVEL, _RUNS, _FOUND = 0, 1, 2
# entries: doc steps, tags, first string, content; contents: bucket hash, strings; texts
_ENTRY = (np.int64, np.int64, np.int32, np.int32, np.uint32, np.uint8, np.uint8)
_STRETCH = (np.int64, np.int64, np.int32, np.int32)


def send(docs: list[tuple[int, int, bytes]], buckets: int, seen: dict[bytes, int] | None = None):
    """(bucket, kind, blob) rows for a task's gathered documents (doc_id, tag, bytes).

    Equal runs are sent with one text and for the least doc_id alone; as every later document has them from that one,
    their strings are found here. seen: the least doc_id of runs that many documents had which the task gathered before;
    what isn't less isn't sent again.
    """
    docs = sorted(docs)
    raw = b"".join(t for _, _, t in docs)
    if len(raw) < DEPTH:
        return
    text = np.frombuffer(raw, np.uint8)
    ends = np.cumsum([len(t) for _, _, t in docs])
    starts = np.concatenate([[0], ends[:-1]])
    ids, tags = (np.array([d[k] for d in docs], np.int64) for k in (0, 1))
    h, own, at, n = runs(text, starts, ends)
    if not len(h):
        return
    rep, content = same_runs(text, at, n + DEPTH - 1, h)
    least = np.full(len(rep), _NEVER)
    np.minimum.at(least, content, ids[own])
    if seen is not None:
        for c in np.flatnonzero(np.bincount(content) >= _MANY).tolist():
            key = raw[at[rep[c]] : at[rep[c]] + n[rep[c]] + DEPTH - 1]
            before = seen.get(key, _NEVER)
            if len(seen) >= _MOST_SEEN:
                seen.clear()
            seen[key] = min(before, int(least[c]))
            least[c] = seen[key]
    lo = at - starts[own]
    late = np.flatnonzero(ids[own] > least[content])
    if len(late):
        yield int(h[late[0]] % np.uint32(buckets)), _FOUND, _pack(ids[own[late]], tags[own[late]], lo[late].astype(np.int32), (lo + n - 1)[late].astype(np.int32))
    bucket = (h % np.uint32(buckets)).astype(np.int64)
    bucket[late] = buckets
    order = np.argsort(bucket, kind="stable")  # by document and place in each
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        some = order[edges[k] : edges[k + 1]]
        if len(some):
            kinds, local = np.unique(content[some], return_inverse=True)
            model = rep[kinds]
            body = text[spread(at[model], n[model] + DEPTH - 1)]
            yield k, _RUNS, _pack(np.diff(ids[own[some]], prepend=0), tags[own[some]], lo[some].astype(np.int32), local.astype(np.int32), h[model], n[model].astype(np.uint8), body)


# --- suffix arrays and their levels ---------------------------------------------------------------------------------


def strings(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The DEPTH bytes from each place on."""
    if not len(at):
        return np.zeros(0, f"S{DEPTH}")
    return sliding_window_view(text, DEPTH)[at].view(f"S{DEPTH}").ravel()


def first_words(some: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(some.view(np.uint8).reshape(-1, DEPTH)[:, :8]).view(">u8").ravel().astype(np.uint64)


@dataclass
class Level:
    """A suffix array cut to DEPTH: places of distinct strings in order, their first bytes, the least doc_id of each."""

    text: np.ndarray
    at: np.ndarray
    word: np.ndarray
    least: np.ndarray

    def scan(self, some: np.ndarray) -> np.ndarray:
        """The least doc_id here of each of the ordered strings, by a merge with those of equal first bytes."""
        out = np.full(len(some), _NEVER)
        words = first_words(some)
        words = words[np.concatenate([[True], words[1:] != words[:-1]])] if len(words) else words
        lo, hi = np.searchsorted(self.word, words, "left"), np.searchsorted(self.word, words, "right")
        near = spread(lo, hi - lo)
        if len(near):
            have = strings(self.text, self.at[near])
            place = np.minimum(np.searchsorted(have, some), len(have) - 1)
            hit = have[place] == some
            out[hit] = self.least[near[place[hit]]]
        return out

    def pack(self) -> bytes:
        return _pack(self.text, self.at.astype(np.int64), self.least)

    @classmethod
    def unpack(cls, blob: bytes) -> Level:
        text, at, least = _unpack(blob, (np.uint8, np.int64, np.int64))
        return cls(text, at, first_words(strings(text, at)), least)


def suffix_array(text: np.ndarray, at: np.ndarray, doc: np.ndarray, kind: str | None = None) -> tuple[Level, np.ndarray, np.ndarray]:
    """(the level of the distinct strings from `at` on, these in order, the place of each of `at` among them)."""
    some = strings(text, at)
    order = np.argsort(some, kind=kind)
    some = some[order]
    new = np.concatenate([[True], some[1:] != some[:-1]])[: len(some)]
    first = np.flatnonzero(new)
    place = np.empty(len(at), np.int64)
    place[order] = np.cumsum(new) - 1
    some = some[first]
    least = np.minimum.reduceat(doc[order], first) if len(first) else doc[:0]
    return Level(text, at[order][first], first_words(some), least), some, place


def merged(a: Level, b: Level) -> Level:
    """One level of two, by a merge of their orders (two ascending runs are all that the stable sort meets)."""
    at = np.concatenate([a.at, b.at + len(a.text)])
    return suffix_array(np.concatenate([a.text, b.text]), at, np.concatenate([a.least, b.least]), "stable")[0]


class Levels:
    """Suffix arrays of geometrically falling sizes."""

    def __init__(self, levels: list[Level] = ()):
        self.levels = list(levels)
        #: levels from the first on that add() has left as they were
        self.kept = len(self.levels)

    def scan(self, some: np.ndarray) -> np.ndarray:
        out = np.full(len(some), _NEVER)
        for level in self.levels:
            np.minimum(out, level.scan(some), out=out)
        return out

    def add(self, level: Level) -> None:
        while self.levels and len(self.levels[-1].at) <= 2 * len(level.at):
            level = merged(self.levels.pop(), level)
        self.kept = min(self.kept, len(self.levels))
        self.levels.append(level)


def may_repeat(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each string of the runs (`size` strings from `at` on, run after run) is like another in bytes of four places.

    A string that isn't equals no other, so it needs no place in a suffix array.
    """
    like = np.empty(size.sum(), np.uint64)
    done = 0
    for i in range(0, len(at), _BATCH_RUNS):
        n = size[i : i + _BATCH_RUNS]
        wide = n + DEPTH - 1
        x = words8(text[spread(at[i : i + _BATCH_RUNS], wide)])
        start = spread(np.cumsum(wide) - wide, n)
        own = np.zeros(len(start), np.uint64)
        for k, off in enumerate((0, 14, 28, DEPTH - 8)):
            own = (own ^ x[start + off]) * _K[k]
            own ^= own >> np.uint64(31)
        like[done : done + len(own)] = own
        done += len(own)
    order = np.argsort(like)
    like = like[order]
    same = like[1:] == like[:-1]
    out = np.zeros(len(like), bool)
    out[order] = np.concatenate([[False], same])[: len(like)] | np.concatenate([same, [False]])[: len(like)]
    return out


def scan_bucket(blobs: list[bytes], index: Levels, alone: bool):
    """(doc, tag, first, last string) of every stretch of strings that an earlier document has too; index grows.

    alone: nothing is asked of the index later, so strings that can't repeat here have no place in it.
    """
    cols, n_contents = [], 0
    for blob in blobs:
        step, tag, lo, content, h, n, text = _unpack(blob, _ENTRY)
        cols.append((np.cumsum(step), tag, lo, content + n_contents, h, n, text))
        n_contents += len(h)
    doc, tag, lo, content, h, size, text = (np.concatenate(c) for c in zip(*cols, strict=True))
    del cols
    size = size.astype(np.int64)
    at = np.cumsum(size + DEPTH - 1) - (size + DEPTH - 1)
    least, most = np.full(n_contents, _NEVER), np.full(n_contents, np.iinfo(np.int64).min)
    np.minimum.at(least, content, doc)
    np.maximum.at(most, content, doc)
    keep = np.ones(n_contents, bool)
    if alone:  # minimisers that several documents have, then strings
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        shared = np.minimum.reduceat(least[order], first) < np.maximum.reduceat(most[order], first)
        keep[order] = np.repeat(shared, np.diff(np.append(first, n_contents)))
    runs_kept = np.flatnonzero(keep)
    begin_of = np.zeros(n_contents, np.int64)  # of a kept run's strings among those of all kept runs
    begin_of[runs_kept] = np.cumsum(size[runs_kept]) - size[runs_kept]
    if alone:
        live = may_repeat(text, at[runs_kept], size[runs_kept]) | np.repeat((least < most)[runs_kept], size[runs_kept])
        if len(live):
            keep[runs_kept] = np.logical_or.reduceat(live, begin_of[runs_kept])
    else:
        live = np.ones(size[runs_kept].sum(), bool)
    own = np.flatnonzero(keep[content])
    own = own[np.argsort(doc[own], kind="stable")]
    for i in range(0, len(own), _BATCH_RUNS):
        entry = own[i : i + _BATCH_RUNS]
        kinds, local = np.unique(content[entry], return_inverse=True)
        rep, same = same_runs(text, at[kinds], size[kinds] + DEPTH - 1, h[kinds])
        n = size[kinds[rep]]
        begin = np.cumsum(n) - n
        alive = np.zeros(n.sum(), bool)
        np.logical_or.at(alive, spread(begin[same], size[kinds]), live[spread(begin_of[kinds], size[kinds])])
        kinds, local = kinds[rep], same[local]
        early = np.full(len(kinds), _NEVER)
        np.minimum.at(early, local, doc[entry])
        wide = n + DEPTH - 1
        body = text[spread(at[kinds], wide)]  # of this batch's runs only
        level, some, place = suffix_array(body, spread(np.cumsum(wide) - wide, n)[alive], np.repeat(early, n)[alive])
        known = index.scan(some)
        fresh = np.flatnonzero(level.least < known)
        if len(fresh):
            index.add(_only(level, fresh, wide))
        before = np.full(n.sum(), _NEVER)  # of each string of each run
        before[alive] = np.minimum(known, level.least)[place]
        count = n[local]
        dup = before[spread(begin[local], count)] < np.repeat(doc[entry], count)
        head = np.zeros(len(dup) + 1, bool)
        head[np.cumsum(count) - count] = True
        on = dup & np.concatenate([[True], ~dup[:-1]]) | dup & head[:-1]
        off = dup & (np.concatenate([~dup[1:], [True]]) | head[1:])
        start, stop = np.flatnonzero(on), np.flatnonzero(off)
        which = np.repeat(np.arange(len(entry)), count)[start]
        base = (np.cumsum(count) - count)[which]
        which = entry[which]
        yield doc[which], tag[which], lo[which] + (start - base), lo[which] + (stop - base)


def _only(level: Level, fresh: np.ndarray, wide: np.ndarray) -> Level:
    """The level with these of its strings, and of the runs (of `wide` bytes) with those they lie in."""
    begin = np.cumsum(wide) - wide
    at = level.at[fresh]
    run = np.repeat(np.arange(len(wide)), wide)[at]
    used, which = np.unique(run, return_inverse=True)
    moved = np.cumsum(wide[used]) - wide[used]
    return Level(level.text[spread(begin[used], wide[used])], at - begin[run] + moved[which], level.word[fresh], level.least[fresh])


def remove(raw: bytes, first: np.ndarray, last: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs of them, the rest), for stretches of strings by their first and last start."""
    if not len(first):
        return 0, 0, raw
    order = np.argsort(first, kind="stable")
    lo, hi = first[order], last[order] + DEPTH
    reach = np.maximum.accumulate(hi)
    new = np.concatenate([[True], lo[1:] > reach[:-1]])
    begins, ends = lo[new].tolist(), np.append(reach[:-1][new[1:]], reach[-1]).tolist()
    kept, at = [], 0
    for a, b in zip(begins, ends, strict=True):
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return sum(ends) - sum(begins), len(begins), b"".join(kept)


# --- the operator ---------------------------------------------------------------------------------------------------

_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("place", pa.int32()), ("blob", pa.binary())])
_SCANNED = pa.schema([("home", pa.int32()), ("bucket", pa.int32()), ("place", pa.int32()), ("n_levels", pa.int32()), ("blob", pa.binary())])


def _spark_type(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'int'}" for f in schema)


def _rows(schema: pa.Schema, rows, step: int = 32):
    """Batches of a few rows, as each may hold a large blob."""
    rows = iter(rows)
    while some := list(itertools.islice(rows, step)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def stored_levels(spark: SparkSession, index: str) -> DataFrame | None:
    """bucket, place, gen, buckets, blob of an index's levels as they are now; None for an empty index.

    Every call writes a generation: the levels it has made or merged, with how many its buckets have since. A level is
    that of its latest generation, if its bucket has so many.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    rows = spark.read.parquet(index)
    now = rows.groupBy("bucket").agg(F.max_by("n_levels", "gen").alias("n"))
    latest = rows.groupBy("bucket", "place").agg(F.max("gen").alias("gen")).join(now, "bucket").filter("place < n")
    return rows.join(latest.select("bucket", "place", "gen"), ["bucket", "place", "gen"], "left_semi").select("bucket", "place", "gen", "buckets", "blob")


def tagged(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with `tag`: 0, or for rows that share their doc_id a hash of the text."""
    ids = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("again"))
    few = ids.limit(MOST_BROADCAST + 1).count()
    if not few:
        return docs.withColumn("tag", F.lit(0).cast("bigint"))
    both = docs.join(F.broadcast(ids) if few <= MOST_BROADCAST else ids, docs["doc_id"] == ids["again"], "left")
    return both.withColumn("tag", F.when(F.col("again").isNull(), F.lit(0)).otherwise(F.xxhash64("text"))).drop("again")


def repeated(docs: DataFrame, homes: int, index: str | None = None) -> DataFrame:
    """(home, blob): stretches of repeated strings, dealt to `homes` by a crc32 of doc_id and tag; docs: doc_id, text, tag.

    With an index folder, its levels count as earlier documents and then take in these.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    levels = stored_levels(spark, index) if index else None
    buckets, gen = 8 * n, 0
    if levels is not None:
        row = levels.agg(F.max("buckets"), F.max("gen")).first()
        buckets, gen = row[0] or buckets, (row[1] or 0) + 1

    def out(batches):
        held, size, seen = [], 0, {}
        for batch in batches:
            for doc, text, tag in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held.append((doc, tag, text.encode("utf-8", "surrogatepass")))
                size += len(held[-1][2])
            if size >= _FLUSH:
                yield from _rows(_SENT, ((k, kind, 0, blob) for k, kind, blob in send(held, buckets, seen)))
                held, size = [], 0
        yield from _rows(_SENT, ((k, kind, 0, blob) for k, kind, blob in send(held, buckets, seen)))

    def scan(batches):
        """One row a home and task, as a shuffle has one block: no more rows than the cluster has pairs of tasks."""
        bucket, index_levels, held, found = None, [], [], []

        def settle():
            if not held:
                return
            family = Levels(index_levels)
            found.extend(scan_bucket(held, family, index is None))
            if index:
                for k, level in enumerate(family.levels[family.kept :], family.kept):
                    yield None, bucket, k, len(family.levels), level.pack()

        for batch in batches:
            for b, kind, blob in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if b != bucket:
                    yield from _rows(_SCANNED, settle(), 1)
                    bucket, index_levels, held = b, [], []
                if kind == _LEVEL:
                    index_levels.append(Level.unpack(blob))
                elif kind == _RUNS:
                    held.append(blob)
                else:
                    found.append(_unpack(blob, _STRETCH))
        yield from _rows(_SCANNED, settle(), 1)
        yield from _rows(_SCANNED, ((k, None, None, None, blob) for k, blob in deal(found)))

    def deal(found):
        if not found:
            return
        doc, tag, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((tag, doc))
        doc, tag, first, last = doc[order], tag[order], first[order], last[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]))[: len(doc)]
        home = np.array([zlib.crc32(f"{d}:{t}".encode()) % homes for d, t in zip(doc[new].tolist(), tag[new].tolist(), strict=True)], np.int64)
        home = np.repeat(home, np.diff(np.append(new, len(doc))))
        order = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[order], np.arange(homes + 1))
        for k in range(homes):
            own = order[edges[k] : edges[k + 1]]
            if len(own):
                yield k, _pack(np.diff(doc[own], prepend=0), tag[own], first[own].astype(np.int32), last[own].astype(np.int32))

    base = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= DEPTH)).select("doc_id", "text", "tag")
    sent = base.mapInArrow(lean(out), _spark_type(_SENT))
    if levels is not None:
        sent = sent.unionByName(levels.select("bucket", F.lit(_LEVEL).alias("kind"), "place", "blob"))
    dealt = sent.repartition(n, "bucket").sortWithinPartitions("bucket", "kind", "place")
    found = cut(dealt.mapInArrow(lean(scan), _spark_type(_SCANNED)), "repeats")
    if index:
        new = found.filter(F.col("home").isNull()).select("bucket", "place", "n_levels", F.lit(gen).alias("gen"), F.lit(buckets).alias("buckets"), "blob")
        new.write.mode("append").parquet(index)
    return found.filter(F.col("home").isNotNull()).select("home", "blob")


class Spans:
    """Stretches of repeated strings of one home's documents."""

    def __init__(self, blobs: list[bytes]):
        self.of: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        got = [_unpack(b, _STRETCH) for b in blobs]
        if got:
            doc, tag = np.concatenate([np.cumsum(g[0]) for g in got]), np.concatenate([g[1] for g in got])
            first, last = np.concatenate([g[2] for g in got]), np.concatenate([g[3] for g in got])
            order = np.lexsort((tag, doc))
            doc, tag, first, last = doc[order], tag[order], first[order], last[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]))[: len(doc)]
            edge = np.append(new, len(doc)).tolist()
            self.of = {(d, t): (first[a:b], last[a:b]) for d, t, a, b in zip(doc[new].tolist(), tag[new].tolist(), edge, edge[1:], strict=False)}

    def cut(self, doc_id: int | None, tag: int, raw: bytes) -> tuple[int, int, bytes]:
        return remove(raw, *self.of[doc_id, tag]) if (doc_id, tag) in self.of else (0, 0, raw)


def _settled(docs: DataFrame, index: str | None, judge, schema) -> DataFrame:
    """judge(batch of docs, spans) for all docs (doc_id, text, tag, and others), in streams of texts behind their stretches.

    A task holds the stretches of its home and one batch of texts. Documents without an id are dealt by their text.
    """
    homes = 2 * partitions(docs.sparkSession)
    found = repeated(docs, homes, index)
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")), F.lit(":"), F.col("tag").cast("string"))
    texts = docs.withColumn("home", (F.crc32(key.cast("binary")) % homes).cast("int")).withColumn("blob", F.lit(None).cast("binary"))
    both = texts.unionByName(found, allowMissingColumns=True)

    def settle(batches):
        blobs, spans = [], None
        for batch in batches:
            of_texts = pa.compute.is_null(batch["blob"])
            blobs += batch.filter(pa.compute.invert(of_texts))["blob"].to_pylist()
            batch = batch.filter(of_texts)
            if len(batch):
                if spans is None:  # blobs come first
                    spans, blobs = Spans(blobs), []
                yield judge(batch, spans)

    dealt = both.repartitionById(homes, F.col("home")).sortWithinPartitions(F.col("blob").isNull())
    return dealt.mapInArrow(lean(settle), schema)


def _documents(docs: DataFrame, *more) -> DataFrame:
    return tagged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more))


def deduplicate(docs: DataFrame, index: str | None = None) -> DataFrame:
    """What each document loses, and a digest of what it keeps."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def judge(batch: pa.RecordBatch, spans: Spans) -> pa.RecordBatch:
        rows = []
        for doc_id, text, tag in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "tag")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            n_removed, n_spans, kept = spans.cut(doc_id, tag, raw)
            rows.append((doc_id, len(raw), n_removed, n_spans, hashlib.sha256(kept).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return _settled(_documents(docs), index, judge, DEDUPED)


def cut_repeats(docs: DataFrame, index: str | None = None) -> DataFrame:
    """The documents with their own columns, repeated strings cut out of `text` and `n_chars` counted anew.

    Bytes of a character that a cut has split go too. Documents that lose their whole text go; untouched ones stay.
    """
    names = docs.columns
    others = [c for c in names if c != "text"]
    kind = docs.schema["text"].dataType

    def judge(batch: pa.RecordBatch, spans: Spans) -> pa.RecordBatch:
        cols = dict(zip(others, batch["row"].flatten(), strict=True))
        n_chars = cols["n_chars"].to_pylist() if "n_chars" in cols else [None] * len(batch)
        texts, keep = [], []
        for k, (doc_id, text, tag, had) in enumerate(zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "tag", "had")), strict=True)):
            n_removed, _, kept = spans.cut(doc_id, tag, text.encode("utf-8", "surrogatepass")) if had else (0, 0, b"")
            if n_removed:
                text = kept.decode("utf-8", "ignore")
                n_chars[k] = len(text)
            texts.append(text if had else None)
            keep.append(bool(text) or not n_removed)
        cols["text"] = pa.array(texts, pa.string())
        if "n_chars" in cols:
            cols["n_chars"] = pa.array(n_chars, cols["n_chars"].type)
        return pa.RecordBatch.from_arrays([cols[c] for c in names], names=names).filter(pa.array(keep, pa.bool_()))

    row = F.struct(*(F.col(f"`{c}`") for c in others))
    schema = StructType([StructField(f.name, StringType() if f.name == "text" else f.dataType) for f in docs.schema])
    found = _settled(_documents(docs, F.col("text").isNotNull().alias("had"), row.alias("row")), index, judge, schema)
    return found.withColumn("text", F.col("text").cast(kind))
