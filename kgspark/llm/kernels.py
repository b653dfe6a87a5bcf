"""Vectorised byte kernels: they work on a whole Arrow batch of texts at a time and never on a single row."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def trim() -> None:
    """Give freed memory back: a Python worker lives on after its task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        _libc().malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


_caches: dict = {}


def enter(operator: str, clear=None) -> None:
    """Start of an operator's task: what other operators remember in this worker is dropped; clear drops ours later."""
    others = [k for k in _caches if k != operator]
    for k in others:
        _caches.pop(k)()
    if others:
        trim()
    if clear:
        _caches[operator] = clear


@functools.cache
def _libc():
    return ctypes.CDLL("libc.so.6")


M1, M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BASE = U(0x9E3779B97F4A7C15)
MULS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: 0 white space, 1 letters, digits and all bytes beyond ASCII, 2 anything else
KIND = np.full(256, 2, dtype=np.uint8)
KIND[SPACE] = 0
KIND[48:58] = KIND[65:91] = KIND[97:123] = 1
KIND[128:] = 1


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * M1
    x ^= x >> U(27)
    x *= M2
    x ^= x >> U(31)
    return x


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = 12 << 20) -> Iterator[pa.Table]:
    """Batches gathered to tables of about `most` bytes of text: what a task holds at a time, whatever its input."""
    held, size = [], 0
    for batch in batches:
        at = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + most - size, side="right"))
            to = min(max(to, at + (not held)), batch.num_rows)
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - base)
            at = to
            if size >= most or at < batch.num_rows:
                if held:
                    yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def parts(offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes, at least one document each: they fit a core's cache."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def runs(b: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of one non-zero kind; runs never cross documents."""
    n = len(b)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    k = kind[b]
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.not_equal(k[1:], k[:-1], out=first[1:])
    inner = offs[(offs < n)]
    first[inner] = True
    s = np.flatnonzero(first)
    e = np.append(s[1:], n)
    real = k[s] > 0
    s, e = s[real], e[real]
    return s, e, np.searchsorted(offs, s, side="right") - 1


def word_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes, A-Z lower-cased."""
    if not len(s):
        return np.zeros(0, np.uint64)
    size = e - s
    at = np.arange(len(b), dtype=np.int64)
    owner = np.zeros(len(b), dtype=np.int32)
    owner[s] = 1
    owner = np.cumsum(owner, dtype=np.int32) - 1
    np.maximum(owner, 0, out=owner)
    rel = at - s[owner]
    inside = (rel >= 0) & (rel < size[owner])
    longest = int(size.max())
    power = np.ones(longest + 1, dtype=np.uint64)
    if longest:
        power[1:] = BASE
        np.multiply.accumulate(power, out=power)
    rel[~inside] = 0
    term = power[rel] * (LOWER[b].astype(np.uint64) + U(1))
    term[~inside] = 0
    return mix(np.add.reduceat(term, s) ^ (size.astype(np.uint64) * M2))


def shingles(b: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): per document the sorted distinct hashes of its k-word shingles.

    Words are maximal runs without ASCII white space, A-Z lower-cased. With fewer than k words the whole sequence
    is one shingle; without words there is none.
    """
    found, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for lo, hi in parts(offs):
        h, at = _shingles(b[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)
        found.append(h)
        sizes.append(np.diff(at))
    return np.concatenate(found), np.cumsum(np.concatenate(sizes))


def _shingles(b: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n_docs = len(offs) - 1
    s, e, doc = runs(b, offs, (~SPACE).astype(np.uint8))
    w = word_hashes(b, s, e)
    count = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    at = np.concatenate([[0], np.cumsum(count)])
    muls = mix(np.arange(1, k + 1, dtype=np.uint64) * BASE) | U(1)
    if len(w) >= k:
        full = np.zeros(len(w) - k + 1, dtype=np.uint64)
        for t in range(k):
            full += w[t : len(w) - k + 1 + t] * muls[t]
        ok = doc[: len(full)] == doc[k - 1 :]
        hs, owner = mix(full[ok]), doc[: len(full)][ok]
    else:
        hs, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    per = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(out_at[-1], dtype=np.uint64)
    big = count >= k
    if len(hs):
        firsts = np.searchsorted(owner, np.arange(n_docs))
        out[out_at[owner] + np.arange(len(owner)) - firsts[owner]] = hs
    for m in range(1, k):
        few = np.flatnonzero(count == m)
        if len(few):
            v = np.full(len(few), m, dtype=np.uint64) * M1
            for t in range(m):
                v += w[at[few] + t] * muls[t]
            out[out_at[few]] = mix(v ^ U(0x5851F42D4C957F2D))
    keep = np.ones(len(out), dtype=bool)
    for d in np.flatnonzero(big):
        lo, hi = out_at[d], out_at[d + 1]
        part = out[lo:hi]
        part.sort()
        keep[lo + 1 : hi] = part[1:] != part[:-1]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[out_at]


def set_signatures(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: equal sets have equal signatures."""
    n = len(at) - 1
    lo, hi = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        lo[full] = np.add.reduceat(mix(h ^ MULS[1]), at[full])
        hi[full] = np.add.reduceat(mix(h * MULS[2] + MULS[3]), at[full])
    return mix(lo + (at[1:] - at[:-1]).astype(np.uint64)), mix(hi ^ MULS[4])
