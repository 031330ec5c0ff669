"""Exact self-join of documents by the Jaccard similarity of their word shingles, and the components of its links.

Documents with equal shingle sets become one. A linked pair shares a shingle among the first few of both sets under any
one order, so sets meet in tiles, one per such shingle; the order puts shingles that many documents have last, so common
passages make no large tiles. A tile is banded by set size: only pairs whose sizes and places allow the similarity come
out. Pairs are bounded by parity bitmaps (the bits in which two differ are elements that only one has), and what is left
is settled by intersecting the sorted sets. Tiles over SMALL, mostly groups of near copies, first give each member its
neighbours in two orders; when the links so found have joined their members, only pairs across components come out.
Tiles that may have more than CELL members are dealt to cells, once for either order, so that none is one task's; what
few tiles, classes or components hold most rows is joined apart from the rest.

Null and empty texts, and those without a word, have an empty set and link with nothing. Repeated rows and equal texts
are one class; sets are known by 64 bits of a digest, those that share them by its other 64. Rows with a null doc_id
take part in links but are no component's id unless it has no other. An empty table gives an empty one; very long texts
count with all their shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, join_hot, lean, partitions, scratch
from .graph import components
from .suffix_dedup import _pack, _unpack

SHINGLE = 5
#: Tiles up to so many sets give all their pairs at once.
SMALL = 32
#: Members of a larger tile that meet others in one task, and entries of a tile from which it's dealt to cells.
BLOCK, CELL = 512, 1024
#: Rows of a tile, set or component from which they are joined apart from those of others.
HOT_TILE = 1024
#: In larger ones a member gets neighbours only by the first so many of its common shingles.
LEADS = 3
#: A shingle in more documents than this comes last in the order; doubled until at most MOST_COMMON shingles do.
COMMON, MOST_COMMON = 32, 1_000_000
#: Documents at most that are fetched by a broadcast of their ids; beyond, by a shuffled join.
MOST_BROADCAST = 1_000_000
#: Bits of a set's id, and sets at most whose ids collide.
ID_BITS, MOST_TWICE = 64, 100_000
_GATHER = 4_000_000
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash's base and of its inverse."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(1 << 17, n + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_hashes(text: str, block: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each word of the text, A-Z lower-cased; words are what lies between ASCII white space."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    parts, at = [], 0
    while at < len(raw):
        end = min(at + block, len(raw))
        space = (raw[at:end] == 32) | ((raw[at:end] >= 9) & (raw[at:end] <= 13))
        while end < len(raw) and not space.any():
            end = min(end + block, len(raw))
            space = (raw[at:end] == 32) | ((raw[at:end] >= 9) & (raw[at:end] <= 13))
        if end < len(raw):
            end = at + int(np.flatnonzero(space)[-1]) + 1
            space = space[: end - at]
        edge = np.diff(np.concatenate([[True], space, [True]]).view(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(first):
            up, down = _power(end - at)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[raw[at:end]] * up[: end - at])])
            h = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)
            h ^= h >> np.uint64(32)
            parts.append(h * _MIX)
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    n = min(SHINGLE, len(words))
    if not n:
        return words
    m = len(words) - n + 1
    h = np.full(m, np.uint64(n))
    for k in range(n):
        h = (h ^ words[k : k + m]) * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(32)
    return np.unique(h * _MIX)


def needed(a, b, percent: int = 80):
    """The least intersection of two linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, percent: int = 80):
    return n - -(-percent * n // 100) + 1


def parity_bits(items: np.ndarray) -> np.ndarray:
    """Parity bitmap as uint64 words: one bit for each element of the set, up to a power of two, 64 at least."""
    size = 64
    while size < len(items):
        size *= 2
    bits = np.bincount((items & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def overlap_bound(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """No smaller than the intersection; bitmaps of two sizes are folded to the smaller."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (n_a + n_b - int(np.bitwise_count(x ^ y).sum())) // 2


def set_ids(items: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """The two halves of the set's digest, of the first only so many bits."""
    raw = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True) >> (64 - bits), int.from_bytes(raw[8:], "little", signed=True)


def set_id(items: np.ndarray, twice: frozenset[int], bits: int = 64) -> int:
    """The first half, unless several sets have it."""
    first, second = set_ids(items, bits)
    return second if first in twice else first


def _gathered(batches, column: int = 1):
    """Lists of (row's other value, text) with about _GATHER characters."""
    held, size = [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(column).to_pylist(), strict=True):
            held.append((key, text))
            size += len(text or "")
            if size >= _GATHER:
                yield held
                held, size = [], 0
    if held:
        yield held


def _rows(schema: pa.Schema, rows: list[tuple], step: int = 64):
    for i in range(0, len(rows), step):
        cols = list(zip(*rows[i : i + step], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _by_bucket(batches):
    """(bucket, its blobs) of a partition sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != bucket and held:
                yield bucket, held
                held = []
            bucket = k
            held.append(blob)
    if held:
        yield bucket, held


_COUNTED = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("other", pa.int64())])


def sets_and_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (doc_id, n, sid, other) of documents, and rows (bucket, blob) of how many of a task's sets hold each shingle."""

    def count(batches):
        for held in _gathered(batches):
            rows, sets = [], {}
            for doc_id, text in held:
                items = shingles(text)
                sid, other = set_ids(items, ID_BITS)
                rows.append((None, None, doc_id, len(items), sid, other))
                if len(items):
                    sets[sid, other] = items
            yield from _rows(_COUNTED, rows, 4096)
            if sets:
                token, times = np.unique(np.concatenate(list(sets.values())) >> np.uint64(32), return_counts=True)
                edges = np.searchsorted((token * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                blobs = []
                for k in range(buckets):
                    own = token[edges[k] : edges[k + 1]]
                    if len(own):
                        blobs.append((k, _pack(np.diff(own, prepend=np.uint64(0)).astype(np.uint32), times[edges[k] : edges[k + 1]].astype(np.uint32)), None, None, None, None))
                yield from _rows(_COUNTED, blobs)

    return docs.mapInArrow(lean(count), "bucket int, blob binary, doc_id bigint, n bigint, sid bigint, other bigint")


def shared_ids(ids: DataFrame) -> frozenset[int]:
    """The sids that several sets have."""
    rows = ids.groupBy("sid").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).filter("lo < hi").select("sid").limit(MOST_TWICE + 1).collect()
    if len(rows) > MOST_TWICE:
        raise ValueError("too many sets share their ids")
    return frozenset(r["sid"] for r in rows)


def common_shingles(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted first halves of the shingles that come last in the order, MOST_COMMON at most, and how many sets may hold each."""
    n = partitions(counts.sparkSession)
    schema = pa.schema([("token", pa.int64()), ("times", pa.int64())])

    def total(batches):
        for _, blobs in _by_bucket(batches):
            got = [_unpack(b, (np.uint32, np.uint32)) for b in blobs]
            token = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
            times = np.concatenate([g[1] for g in got]).astype(np.int64)
            order = np.argsort(token, kind="stable")
            token, times = token[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            sums = np.add.reduceat(times, first)
            hit = sums > COMMON
            yield pa.RecordBatch.from_arrays([pa.array(token[first][hit].astype(np.int64)), pa.array(sums[hit])], schema=schema)

    found = cut(counts.select("bucket", "blob").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(total), "token bigint, times bigint"), "common")
    least = COMMON
    while found.filter(F.col("times") > least).count() > MOST_COMMON:
        least *= 2
    got = found.filter(F.col("times") > least).select("token", "times").toArrow().sort_by("token")  # as arrays, not as rows
    return got["token"].to_numpy().astype(np.uint64), got["times"].to_numpy()


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], buckets: int, twice: frozenset[int] = frozenset()) -> DataFrame:
    """(bucket, blob) rows of the sets' first shingles: shingle, cell, set, its size, place in the order, and among common ones.

    Cell 0 is that of shingles with CELL sets at most. Others have odd cells for the order by size, even ones for the other.
    """
    shared = docs.sparkSession.sparkContext.broadcast((*common, twice))

    def first_ones(batches):
        last, times, again = shared.value
        for held in _gathered(batches):
            sets = {}
            for _, text in held:
                items = shingles(text)
                if len(items):
                    sets[set_id(items, again, ID_BITS)] = items
            tokens, sizes, nths = [], [], []
            for items in sets.values():
                p = prefix_length(len(items))
                if len(last):
                    half = items >> np.uint64(32)
                    at = np.searchsorted(last, half)
                    late = last[np.minimum(at, len(last) - 1)] == half
                    items = np.concatenate([items[~late], items[late]])
                    rare = int((~late).sum())
                else:
                    rare = len(items)
                tokens.append(items[:p])
                sizes.append(len(items))
                nths.append(np.maximum(np.arange(p) - rare, 0))
            if not tokens:
                continue
            lengths = np.array([len(t) for t in tokens])
            token = np.concatenate(tokens)
            sid = np.repeat(np.array(list(sets), np.int64), lengths)
            size = np.repeat(np.array(sizes, np.int32), lengths)
            place = (np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            nth = np.minimum(np.concatenate(nths), 255).astype(np.uint8)
            half = token >> np.uint64(32)
            cell = np.zeros(len(token), np.uint32)
            at = np.minimum(np.searchsorted(last, half), max(len(last) - 1, 0))
            hot = np.flatnonzero((last[at] == half) & (times[at] > CELL)) if len(last) else np.zeros(0, np.int64)
            if len(hot):
                cells = (times[at[hot]] // CELL + 1).astype(np.uint64)
                mixed = sid[hot].view(np.uint64) * _MIX
                cell[hot] = 2 * ((mixed >> np.uint64(33)) % cells) + np.uint64(1)
                led = nth[hot] < LEADS
                other = (mixed[led] * _MIX) >> np.uint64(33)
                token, sid, size, place, nth, half = (np.concatenate([c, c[hot[led]]]) for c in (token, sid, size, place, nth, half))
                cell = np.concatenate([cell, (2 * (other % cells[led]) + np.uint64(2)).astype(np.uint32)])
            bucket = (((half ^ (cell.astype(np.uint64) * _MIX >> np.uint64(32))) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.lexsort((token, bucket))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            rows = []
            for k in range(buckets):
                own = order[edges[k] : edges[k + 1]]
                if len(own):
                    rows.append((k, _pack(np.diff(token[own], prepend=np.uint64(0)), cell[own], sid[own], size[own], place[own], nth[own])))
            yield from _rows(pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]), rows)

    return docs.mapInArrow(lean(first_ones), "bucket int, blob binary")


_TILE = pa.schema([("tile", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("place", pa.int64())])


def tiles(found: DataFrame) -> DataFrame:
    """Pairs (tile null, a < b), and the members (b null: tile, a, n, place) of tiles over SMALL and of those in cells."""
    n_parts = partitions(found.sparkSession)

    def pair_up(batches):
        for _, blobs in _by_bucket(batches):
            got = [_unpack(b, (np.uint64, np.uint32, np.int64, np.int32, np.int32, np.uint8)) for b in blobs]
            token = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
            cell, sid, size, place, nth = (np.concatenate([g[k] for g in got]) for k in (1, 2, 3, 4, 5))
            order = np.lexsort((sid, size, cell, token))
            token, cell, sid, size, place, nth = token[order], cell[order], sid[order], size[order].astype(np.int64), place[order].astype(np.int64), nth[order]
            new = (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])
            keep = np.concatenate([[True], new | (sid[1:] != sid[:-1])])
            token, cell, sid, size, place, nth = token[keep], cell[keep], sid[keep], size[keep], place[keep], nth[keep]
            new = (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])
            group = np.concatenate([[0], np.cumsum(new)])
            count = np.bincount(group)
            member = np.where(cell == 0, count[group], SMALL + 1)
            pairs = []
            # small tiles: each member with those after it, by distance
            for d in range(1, SMALL):
                left = np.flatnonzero((member[:-d] > d) & (member[:-d] <= SMALL) & (group[:-d] == group[d:])) if d < len(token) else np.zeros(0, np.int64)
                if not len(left):
                    break
                pairs.append((left, left + d))
            big = np.flatnonzero(member > SMALL)
            if len(big):
                led = big[nth[big] < LEADS]
                sized = led[(cell[led] == 0) | (cell[led] % 2 == 1)]
                near = np.flatnonzero(group[sized[:-1]] == group[sized[1:]])
                pairs.append((sized[near], sized[near + 1]))
                other = led[cell[led] % 2 == 0]
                mixed = sid[other].view(np.uint64) * _MIX
                other = other[np.lexsort((mixed ^ (mixed >> np.uint64(29)), group[other]))]
                near = np.flatnonzero(group[other[:-1]] == group[other[1:]])
                pairs.append((other[near], other[near + 1]))
                big = big[(cell[big] == 0) | (cell[big] % 2 == 1)]  # each member once
            if pairs:
                x, y = (np.concatenate(c) for c in zip(*pairs, strict=True))
                least = needed(size[x], size[y])
                ok = (size[x] - place[x] >= least) & (size[y] - place[y] >= least) & (np.minimum(size[x], size[y]) >= least)
                both = np.unique(np.stack([np.minimum(sid[x[ok]], sid[y[ok]]), np.maximum(sid[x[ok]], sid[y[ok]])], 1), axis=0)
                for i in range(0, len(both), 50_000):
                    some = both[i : i + 50_000]
                    none = pa.nulls(len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, pa.array(some[:, 0]), pa.array(some[:, 1]), none, none], schema=_TILE)
            for i in range(0, len(big), 50_000):
                some = big[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(token[some].view(np.int64)), pa.array(sid[some]), pa.nulls(len(some), pa.int64()), pa.array(size[some]), pa.array(place[some])], schema=_TILE)

    return found.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(pair_up), "tile bigint, a bigint, b bigint, n bigint, place bigint")


_SET = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("items", pa.binary())])


def fetch_sets(docs: DataFrame, ids: DataFrame, wanted: DataFrame, twice: frozenset[int] = frozenset()) -> DataFrame:
    """sid, n, parity bitmap and sorted items of the wanted sets, each made from the first document that has it, or from a row without an id."""
    first = ids.groupBy("sid").agg(F.min("doc_id").alias("doc_id")).join(wanted, "sid")
    first = cut(first.select("doc_id", F.when(F.col("doc_id").isNull(), F.col("sid")).alias("alone")).distinct(), "wanted")
    alone = first.filter("alone is not null").select(F.col("alone").alias("sid"))
    first = first.filter("doc_id is not null").select("doc_id")
    few = first.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    some = docs.join(F.broadcast(first) if few else first, "doc_id", "left_semi")

    def make(batches):
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                items = shingles(text)
                if len(items):
                    rows.append((set_id(items, twice, ID_BITS), len(items), parity_bits(items).tobytes(), items.tobytes()))
            yield from _rows(_SET, rows, 256)

    made = "sid bigint, n bigint, bits binary, items binary"
    named = some.select("text").mapInArrow(lean(make), made).join(wanted, "sid", "left_semi")
    if not alone.isEmpty():
        unnamed = docs.filter(F.col("doc_id").isNull()).select("text").mapInArrow(lean(make), made)
        named = named.unionByName(unnamed.join(alone, "sid", "left_semi"))
    return cut(named.groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("items").alias("items")), "sets")


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _settled(pairs: DataFrame, sets: DataFrame, what: str, test) -> DataFrame:
    """The pairs (a, b) that pass a test of both sides' `what` and sizes."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col(what).alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col(what).alias("y"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "x", "y")

    def keep(batches):
        for batch in batches:
            a, b, n_a, n_b, x, y = (batch.column(i).to_pylist() for i in range(6))
            ok = [k for k in range(len(a)) if test(x[k], y[k], n_a[k], n_b[k])]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in ok], pa.int64()), pa.array([b[k] for k in ok], pa.int64())], schema=_PAIR)

    return rows.mapInArrow(lean(keep), "a bigint, b bigint")


def bounded(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs whose bitmaps allow a link."""
    return _settled(pairs, sets, "bits", lambda x, y, n_a, n_b: overlap_bound(x, y, n_a, n_b) >= needed(n_a, n_b, percent))


def linked(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs whose sorted sets overlap enough."""

    def test(x, y, n_a, n_b):
        common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        return 100 * common >= percent * (n_a + n_b - common)

    return _settled(pairs, sets, "items", test)


def _folded(bits: list[bytes], words: int) -> np.ndarray:
    out = np.empty((len(bits), words), np.uint64)
    for k, raw in enumerate(bits):
        x = np.frombuffer(raw, np.uint64)
        while len(x) > words:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[k] = x
    return out


def across(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """Pairs of large tiles whose sets lie in two components and whose bitmaps allow a link, each from one tile.

    A tile's members are banded by size (a linked pair's bands are the same or neighbours) and, within a band, dealt to
    blocks of about BLOCK; a task meets two blocks. A component with over BLOCK members in a band has blocks of its own,
    which don't meet each other. A pair comes out of the first tile that both sets are in.
    """
    with_root = cut(members.join(roots, members["sid"] == roots["node"], "left").select("tile", "sid", F.coalesce("root", "sid").alias("root")), "members")
    split = with_root.groupBy("tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("tile")
    open_ = join_hot(with_root, split, ["tile"], least=HOT_TILE)
    per_set = open_.groupBy("sid").agg(F.first("root").alias("root"), F.sort_array(F.collect_set("tile")).alias("tiles"))  # at most a prefix's tiles
    full = per_set.join(sets.select("sid", "n", "bits"), "sid").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.25)))).cast("int"))
    placed = cut(full.withColumn("tile", F.explode("tiles")), "placed")
    # large components of a band, and 0 for all others, with their blocks
    per_root = placed.groupBy("tile", "band", "root").agg(F.count("*").alias("members"))
    large = F.col("members") > BLOCK
    kinds = per_root.groupBy("tile", "band", F.when(large, F.col("root")).alias("own")).agg(F.ceil(F.sum("members") / BLOCK).cast("int").alias("blocks"))
    order = Window.partitionBy("tile", "band").orderBy(F.col("own").asc_nulls_first())  # a row for every BLOCK members at most
    kinds = kinds.withColumn("stop", F.sum("blocks").over(order).cast("int")).withColumn("start", F.col("stop") - F.col("blocks"))
    bands = kinds.groupBy("tile", "band").agg(F.max("stop").alias("total"), F.map_from_entries(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("own", F.struct("start", "stop"))))).alias("own"), F.max(F.when(F.col("own").isNull(), F.col("stop"))).alias("rest"))
    bands = cut(bands, "bands")

    def shifted(by: int, name: str) -> DataFrame:
        return bands.select("tile", (F.col("band") - by).alias("band"), F.col("total").alias(f"total_{name}"), F.col("own").alias(f"own_{name}"))

    bands = bands.join(shifted(1, "above"), ["tile", "band"], "left").join(shifted(-1, "below"), ["tile", "band"], "left")
    own = join_hot(placed, bands, ["tile", "band"], least=HOT_TILE)
    own = own.withColumn("mine", F.col("own")[F.col("root")]).withColumn("mine_above", F.col("own_above")[F.col("root")]).withColumn("mine_below", F.col("own_below")[F.col("root")])
    first, count = F.coalesce(F.col("mine.start"), F.lit(0)), F.coalesce(F.col("mine.stop") - F.col("mine.start"), F.col("rest"))
    own = own.withColumn("block", (first + F.pmod(F.xxhash64("sid"), count)).cast("int"))
    keys = ["tile", "band", "block", "other_band", "other_block"]
    cols = ["sid", "n", "root", "bits", "tiles"]

    def facing(shift: int, low: Column, high: Column, mine: str) -> Column:
        """(band, block) of the blocks from low up to high that a member's block meets: all but those of its own large component."""
        none = F.array().cast("array<struct<band: int, block: int>>")
        every = F.when(high > low, F.sequence(low, F.greatest(high - 1, low))).otherwise(F.array().cast("array<int>"))
        met = F.filter(every, lambda k: F.col("mine").isNull() | F.col(mine).isNull() | (k < F.col(f"{mine}.start")) | (k >= F.col(f"{mine}.stop")))
        return F.coalesce(F.transform(met, lambda k: F.struct((F.col("band") + shift).cast("int").alias("band"), k.cast("int").alias("block"))), none)

    right_of = F.concat(facing(0, F.col("block"), F.col("total"), "mine"), facing(1, F.lit(0), F.coalesce("total_above", F.lit(0)), "mine_above"))
    left_of = F.concat(facing(0, F.lit(0), F.col("block") + 1, "mine"), facing(-1, F.lit(0), F.coalesce("total_below", F.lit(0)), "mine_below"))
    left = own.withColumn("o", F.explode(right_of)).select("tile", "band", "block", F.col("o.band").alias("other_band"), F.col("o.block").alias("other_block"), *cols)
    right = own.withColumn("o", F.explode(left_of)).select("tile", F.col("o.band").alias("band"), F.col("o.block").alias("block"), F.col("band").alias("other_band"), F.col("block").alias("other_block"), *cols)

    right = right.toDF(*(f"{c}_y" for c in right.columns))  # columns of their own, so that no name is ambiguous

    def meet(key, x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.rename_columns([c.removesuffix("_y") for c in y.column_names])
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(x) or not len(y):
            return none
        tile = key[0].as_py()
        sid_x, n_x, root_x = (x[c].to_numpy() for c in ("sid", "n", "root"))
        sid_y, n_y, root_y = (y[c].to_numpy() for c in ("sid", "n", "root"))
        bits_x, bits_y = x["bits"].to_pylist(), y["bits"].to_pylist()
        words = min(min(map(len, bits_x)), min(map(len, bits_y))) // 8
        fold_x, fold_y = _folded(bits_x, words), _folded(bits_y, words)
        before = [[t for t in r if t < tile] for r in x["tiles"].to_pylist()], [[t for t in r if t < tile] for r in y["tiles"].to_pylist()]
        index = {t: k for k, t in enumerate(sorted({t for side in before for r in side for t in r}))}
        had = [np.zeros((len(side), len(index) + 1), np.float32) for side in before]
        for matrix, side in zip(had, before, strict=True):
            for k, r in enumerate(side):
                matrix[k, [index[t] for t in r]] = 1
        same = tuple(k.as_py() for k in key[1:3]) == tuple(k.as_py() for k in key[3:5])
        a, b = [], []
        step = max(1, 2_000_000 // (len(sid_y) * words))
        for i in range(0, len(sid_x), step):
            apart = np.bitwise_count(fold_x[i : i + step, None, :] ^ fold_y[None]).sum(2, dtype=np.int64)
            total = n_x[i : i + step, None] + n_y[None]
            ok = (total - apart) // 2 >= needed(total, 0, percent)
            ok &= (root_x[i : i + step, None] != root_y[None]) & (had[0][i : i + step] @ had[1].T == 0)
            if same:
                ok &= sid_x[i : i + step, None] < sid_y[None]
            p, q = np.nonzero(ok)
            a.append(sid_x[i + p])
            b.append(sid_y[q])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return left.groupBy(*keys).cogroup(right.groupBy(*(f"{k}_y" for k in keys))).applyInArrow(meet, "a bigint, b bigint")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; what was written on the way is dropped."""
    with scratch() as (keep, kept):
        keep(_near_classes(docs), "classes")
    return kept[0].df


def _near_classes(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = cut(sets_and_counts(base, buckets), "counted")
    ids = counted.filter(F.col("sid").isNotNull()).select("doc_id", "n", "sid", "other")
    twice = shared_ids(ids)
    if twice:
        ids = ids.withColumn("sid", F.when(F.col("sid").isin(*twice), F.col("other")).otherwise(F.col("sid")))
    ids = ids.drop("other")
    common = common_shingles(counted.filter(F.col("blob").isNotNull()))
    tiled = cut(tiles(prefixes(base, common, buckets, twice)), "tiles")
    pairs = cut(tiled.filter(F.col("b").isNotNull()).select("a", "b").distinct(), "pairs")
    members = tiled.filter(F.col("b").isNull()).select("tile", F.col("a").alias("sid"), "n", "place")
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(members.select("sid")).distinct()
    sets = fetch_sets(base, ids.filter("n > 0"), wanted, twice)
    links = cut(linked(cut(bounded(pairs, sets), "possible"), sets), "links")
    roots = components(links.toDF("u", "v"))
    more = cut(across(members, roots, sets), "across")
    if more.limit(1).count():
        links = links.unionByName(cut(linked(more, sets), "more_links"))
        roots = components(links.toDF("u", "v"))
    n = ids.count()
    rooted = cut(join_hot(ids, roots.toDF("sid", "root"), ["sid"], "left", least=HOT_TILE, rows=n).select("doc_id", "n", F.coalesce("root", "sid").alias("root")), "rooted")
    full = rooted.filter("n > 0")
    least = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = join_hot(full, least, ["root"], least=HOT_TILE, rows=n).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rooted.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(empty)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among `ids`."""
    few = ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each class of near duplicates the document with the least id, with its own columns.

    Rows that share a doc_id are one document: one of them stays if any of them leads its class, the one with the least
    text (none before any), ties by a hash of all columns. Rows without an id all stay.
    """
    classes = near_classes(docs).filter(F.col("doc_id").isNotNull())
    per_id = cut(classes.groupBy("doc_id").agg(F.count("*").alias("n"), F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays")), "per_id")
    kept = without(docs, per_id.filter("stays = 0 or n > 1").select("doc_id"))
    again = per_id.filter("stays = 1 and n > 1").select("doc_id")
    if again.limit(1).count():
        names = [F.col(f"`{c}`") for c in docs.columns]
        row, order = F.struct(*names), F.struct(F.col("text").cast("string"), F.xxhash64(*names))
        repeated = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("row"))
        kept = kept.unionByName(repeated.select("row.*"))
    return kept
