"""Byte-level BPE encoding and decoding of whole texts, long ones chunk by chunk.

A long text is dealt out as overlapping chunks. Each chunk is pre-tokenised on its own; two neighbours are stitched at
the first pre-token boundary behind a character other than white space that both find in their overlap, and from there
on the pattern, which looks at nothing before its match, splits both alike. The pieces between stitches are encoded wherever they lie, and a document's ids
are put together in order. A text in which some overlap has no common boundary (a run of one character class longer
than the overlap) is encoded as one piece.

Nulls: a null text is empty (no tokens); a null doc_id is kept. Repeated rows give repeated rows, an empty table none.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, lean, partitions

CODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Characters at a chunk's end that a match may still look at: the longest contraction.
MARGIN = 4

_codecs: dict[tuple, tuple] = {}


def codec(path: str, pattern: str):
    """(encoder, compiled pattern), once per worker."""
    if (path, pattern) not in _codecs:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        _codecs[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), regex.compile(pattern)
    return _codecs[path, pattern]


def digests(ids, raw: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = 16_384, overlap: int = 512) -> DataFrame:
    """One row per document: token count, digests of its ids and of the bytes they decode to."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > chunk

    def whole(batches):
        enc, _ = codec(ranks_path, pattern)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode_ordinary(text)
                out.append((doc_id, *digests(ids, enc.decode_bytes(ids))))
            yield _batch(out, _CODED)

    short = base.filter(~long).mapInArrow(lean(whole), CODED)
    return short.unionByName(encode_chunked(base.filter(long), ranks_path, pattern, chunk, overlap))


def encode_chunked(docs: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """As encode(), with every document dealt out in chunks."""
    spark = docs.sparkSession
    parts = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("start", pa.int64()), ("body", pa.string())])

    def split(batches):
        for batch in batches:
            for key, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield _batch([(key, doc_id, k, at, text[at : at + chunk + overlap]) for k, at in enumerate(range(0, len(text), chunk))], parts)

    chunks = cut(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").mapInArrow(split, "key bigint, doc_id bigint, k int, start bigint, body string"), "chunks")
    marks = pa.schema([("key", pa.int64()), ("k", pa.int32()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])

    def mark(batches):
        _, pat = codec(ranks_path, pattern)
        for batch in batches:
            out = []
            for key, k, at, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                starts = np.array([m.start() for m in pat.finditer(body)], np.int64)
                # a piece must not end in white space: how far the pattern takes a run of it depends on what follows
                starts = np.array([s for s in starts[(starts < overlap) | (starts >= chunk)].tolist() if s and not body[s - 1].isspace()], np.int64)
                tail = starts[(starts >= chunk) & (starts <= len(body) - MARGIN)] + at
                out.append((key, k, (starts[starts < overlap] + at).tolist(), tail.tolist()))
            yield _batch(out, marks)

    n = partitions(spark)
    found = chunks.select("key", "k", "start", "body").repartition(n, "key", "k").mapInArrow(lean(mark), "key bigint, k int, head array<bigint>, tail array<bigint>")
    order = Window.partitionBy("key").orderBy("k")  # a document's chunks: their marks only
    last = F.lead("k").over(order).isNull()
    stitch = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    cuts = found.select("key", "k", last.alias("last"), F.when(~last, stitch).alias("to"))
    cuts = cuts.withColumn("from", F.coalesce(F.lag("to").over(order), F.lit(0))).withColumn("lost", F.max((F.col("to").isNull() & ~F.col("last")).cast("int")).over(Window.partitionBy("key")))
    pieces = chunks.join(cuts, ["key", "k"]).select("key", "doc_id", "k", "start", "from", "to", "lost", "body")
    coded = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("start", pa.int64()), ("ids", pa.binary()), ("body", pa.string())])

    def code(batches):
        enc, _ = codec(ranks_path, pattern)
        for batch in batches:
            out = []
            for key, doc_id, k, start, lo, hi, lost, body in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if lost:
                    out.append((key, doc_id, k, start, None, body[:chunk]))
                else:
                    ids = enc.encode_ordinary(body[lo - start : None if hi is None else hi - start])
                    out.append((key, doc_id, k, start, np.asarray(ids, "<u4").tobytes(), None))
            yield _batch(out, coded)

    def join(group: pa.Table) -> pa.Table:
        enc, _ = codec(ranks_path, pattern)
        group = group.sort_by("k")
        if group["body"].null_count:
            ids = np.frombuffer(b"".join(group["ids"].to_pylist()), "<u4").tolist()
        else:
            ids = enc.encode_ordinary("".join(group["body"].to_pylist()))
        raw = b"".join(enc.decode_bytes(ids[i : i + 65_536]) for i in range(0, len(ids), 65_536))
        return pa.Table.from_batches([_batch([(group["doc_id"][0].as_py(), *digests(ids, raw))], _CODED)])

    rows = pieces.mapInArrow(lean(code), "key bigint, doc_id bigint, k int, start bigint, ids binary, body string")
    return rows.groupBy("key").applyInArrow(join, CODED)
