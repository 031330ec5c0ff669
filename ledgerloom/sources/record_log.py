"""Binary logs of order events as a Spark source: `spark.read.format("record_log").load(path)`.

A log is a header (its mark, a version, the length of its metadata) and records of one size, plain or in zstd frames. A
plain log is cut into stretches of records, each a task's; a compressed one is read by one task, in pieces. Several files
or a folder are read in order of name.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The layout of a log of order events, little-endian, as its publisher's open encoding has it.
MARK = b"DBN"
HEADER = struct.Struct("<3sBI")
RECORD = struct.Struct("<BBHIQQqIBBccQiI")
KIND = 0xA0
ZSTD = b"\x28\xb5\x2f\xfd"
UNDEFINED_PRICE, UNDEFINED_TIME = 2**63 - 1, 2**64 - 1
PRICE_SCALE = 1e9

SCHEMA = (
    "file string, source_row bigint, ts_recv bigint, ts_event bigint, action string, side string, price double, size double, "
    "order_id decimal(20,0), flags int, sequence bigint, publisher_id int, instrument_id bigint, channel_id int, ts_in_delta int"
)
_ARROW = pa.schema([
    ("file", pa.string()), ("source_row", pa.int64()), ("ts_recv", pa.int64()), ("ts_event", pa.int64()), ("action", pa.string()), ("side", pa.string()), ("price", pa.float64()), ("size", pa.float64()),
    ("order_id", pa.decimal128(20, 0)), ("flags", pa.int32()), ("sequence", pa.int64()), ("publisher_id", pa.int32()), ("instrument_id", pa.int64()), ("channel_id", pa.int32()), ("ts_in_delta", pa.int32()),
])


class LogError(ValueError):
    """A log that ends inside a frame, its header or a record, or holds something else."""


def _plain(path: str, piece: int) -> Iterator[bytes]:
    """The log's bytes in pieces, frames of zstd unpacked one after the other."""
    import zstandard

    with open(path, "rb") as f:
        head = f.read(4)
        f.seek(0)
        if head != ZSTD:
            while data := f.read(piece):
                yield data
            return
        engine, whole = zstandard.ZstdDecompressor().decompressobj(), True
        while data := f.read(piece):
            while data:
                out = engine.decompress(data)
                whole = engine.eof
                if out:
                    yield out
                data = engine.unused_data if engine.eof else b""
                if engine.eof:
                    engine = zstandard.ZstdDecompressor().decompressobj()
        if not whole:
            raise LogError(f"{path}: the last frame is cut off")


def header_length(path: str, head: bytes) -> int:
    if len(head) < HEADER.size:
        raise LogError(f"{path}: no header")
    mark, version, length = HEADER.unpack_from(head)
    if mark != MARK or version not in (1, 2, 3):
        raise LogError(f"{path}: not a log of order events")
    return HEADER.size + length


def _time(value: int) -> int | None:
    return None if value == UNDEFINED_TIME else value


def decode(path: str, data: bytes, first: int) -> pa.RecordBatch:
    """Whole records, the first of them the log's number `first`."""
    rows = []
    for k, r in enumerate(RECORD.iter_unpack(data)):
        length, kind, publisher, instrument, event, order, price, size, flags, channel, action, side, recv, delta, sequence = r
        if kind != KIND or 4 * length != RECORD.size:
            raise LogError(f"{path}: record {first + k} isn't an order event")
        rows.append((path, first + k, _time(recv), _time(event), action.decode("ascii"), side.decode("ascii"), None if price == UNDEFINED_PRICE else price / PRICE_SCALE, float(size), order, flags, sequence, publisher, instrument, channel, delta))
    cols = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def records(path: str, piece: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """All records of a log, plain or compressed, a piece at a time; whole or a LogError."""
    held, skip, at = b"", None, 0
    for data in _plain(path, piece):
        held += data
        if skip is None:
            if len(held) < HEADER.size:
                continue
            skip = header_length(path, held)
        if len(held) < skip:
            continue
        held, skip = held[skip:], 0
        n = len(held) // RECORD.size
        if n:
            yield decode(path, held[: n * RECORD.size], at)
            held, at = held[n * RECORD.size :], at + n
    if skip is None or skip:
        raise LogError(f"{path}: no header")
    if held:
        raise LogError(f"{path}: {len(held)} bytes after the last record")


class _Stretch(InputPartition):
    def __init__(self, path: str, start: int | None, first: int, count: int):
        self.path, self.start, self.first, self.count = path, start, first, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = _files(options.get("path", ""))
        self.rows = int(options.get("rowsPerTask", 4_000_000))
        self.piece = int(options.get("pieceBytes", 1 << 18))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            with open(path, "rb") as f:
                head = f.read(HEADER.size)
            if head[:4] == ZSTD:
                out.append(_Stretch(path, None, 0, 0))
                continue
            skip = header_length(path, head)
            n, rest = divmod(os.path.getsize(path) - skip, RECORD.size)
            if n < 0 or rest:
                raise LogError(f"{path}: ends inside a record")
            out += [_Stretch(path, skip + at * RECORD.size, at, min(self.rows, n - at)) for at in range(0, n, self.rows)]
        return out or [_Stretch("", 0, 0, 0)]

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        if partition.start is None:
            yield from records(partition.path, self.piece)
            return
        if not partition.count:
            return
        step = max(1, self.piece // RECORD.size)
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            for at in range(0, partition.count, step):
                n = min(step, partition.count - at)
                data = f.read(n * RECORD.size)
                if len(data) != n * RECORD.size:
                    raise LogError(f"{partition.path}: shorter than it was")
                yield decode(partition.path, data, partition.first + at)


def _files(path: str) -> list[str]:
    if not path:
        raise ValueError("load() needs a path")
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith((".dbn", ".dbn.zst")))
    return [path]


class RecordLog(DataSource):
    """Files must lie where all executors can open them: a shared, mounted folder."""

    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(RecordLog)
    return spark


def write_log(path: str, rows: list[tuple], compressed: bool = False, metadata: bytes = b"") -> None:
    """A small log, for tests and samples; rows: (ts_recv, ts_event, action, side, price, size, order_id, flags, sequence, publisher, instrument)."""
    import zstandard

    body = b"".join(
        RECORD.pack(RECORD.size // 4, KIND, publisher, instrument, event, order, UNDEFINED_PRICE if price is None else round(price * PRICE_SCALE), size, flags, 0, action.encode(), side.encode(), UNDEFINED_TIME if recv is None else recv, 0, sequence)
        for recv, event, action, side, price, size, order, flags, sequence, publisher, instrument in rows
    )
    data = HEADER.pack(MARK, 1, len(metadata)) + metadata + body
    with open(path, "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(data) if compressed else data)
