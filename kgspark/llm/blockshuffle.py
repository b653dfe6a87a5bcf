"""Fixed-width records sent to hash buckets as packed, compressed blocks: a few large rows instead of one row a record."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SCHEMA = "bucket int, block binary"
ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])


def _pressed(records: np.ndarray) -> bytes:
    """The number of records, then their columns one after the other, compressed."""
    data = b"".join(np.ascontiguousarray(records[c]).tobytes() for c in records.dtype.names)
    return len(records).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def pack(key: np.ndarray, records: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, block) for records, dealt by the high bits of key (64 bits, evenly spread)."""
    if not len(records):
        return
    to = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    records, to = records[order], to[order]
    cut = np.flatnonzero(to[1:] != to[:-1]) + 1
    cut = np.concatenate([[0], cut, [len(to)]])
    rows = [(int(to[a]), _pressed(records[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for i in range(0, len(rows), 256):
        some = rows[i : i + 256]
        yield pa.record_batch([pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.binary())], schema=ARROW)


def spread(records: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row with all records, to a negative bucket that depends on the records of the block and on no key."""
    if len(records):
        data = _pressed(records)
        to = -1 - zlib.crc32(data) % buckets
        yield pa.record_batch([pa.array([to], pa.int32()), pa.array([data], pa.binary())], schema=ARROW)


def unpack(table: pa.Table, dtype: np.dtype) -> np.ndarray:
    """The records of all blocks."""
    codec, blocks = pa.Codec("zstd"), [v.as_buffer() for chunk in table.column("block").chunks for v in chunk]
    sizes = [int.from_bytes(b[:8].to_pybytes(), "little") for b in blocks]
    out, at = np.zeros(sum(sizes), dtype), 0
    for block, n in zip(blocks, sizes, strict=True):
        data, start = codec.decompress(block[8:], n * dtype.itemsize), 0
        for c in dtype.names:
            kind = dtype[c]
            out[c][at : at + n] = np.frombuffer(data, kind.base, n * (kind.itemsize // kind.base.itemsize), start).reshape((n, *kind.shape))
            start += n * kind.itemsize
        at += n
    return out
