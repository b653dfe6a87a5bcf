"""Periodic runs of words, by Main-Lorentz divide and conquer on interned word ids.

A run is a maximal stretch of words with smallest period q and at least `times` * q words (and `least` words). The texts of a
batch are one array of word ids with a mark of its own after each text, so no run crosses texts. The array is halved
down to four words (segments aligned at powers of two, all of a level at once). A run that fits a segment and crosses its
midpoint has, being four periods long, two of them on one side of it: there the side, read away from the midpoint, begins
with a square, which its Z-function shows. Squares of a smaller root are passed over, the others extended to both sides to a
maximal run; a run found at several midpoints counts once, with its smallest period.

Before a Z-function is worked out, a few words of each candidate period are compared for all midpoints of the level; most
midpoints of prose have none left. Z-functions are linear, and a square within a run that is known is not extended
again, so a text that is one word repeated costs n log n too.

Edge cases: null, empty or blank text has no words and no runs; null or repeated doc_ids and repeated rows are treated row by
row; texts of any length cost n log n; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import read_table

LEAST, TIMES, WORDS = 6, 4, 400_000

#: A run as (start, end, period)
Run = tuple[int, int, int]


def z_function(x: list[int]) -> list[int]:
    """z[i]: how many items from i on equal those from 0 on."""
    n = len(x)
    z = [0] * n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def roots(x: list[int]) -> list[int]:
    """The lengths q, ascending, of primitive roots of squares that x begins with."""
    z, found = z_function(x), []
    for q in range(1, len(x) // 2 + 1):
        if z[q] >= q and not any(q % p == 0 and z[p] >= 2 * q - p for p in found):
            found.append(q)
    return found


def _same(x: np.ndarray, a: int, b: int, step: int) -> int:
    """How many items from a on equal those from b on, going up (step 1) or down (-1); in chunks that double."""
    n, size = 0, 16
    while True:
        size = min(size, len(x) - max(a, b)) if step > 0 else min(size, min(a, b) + 1)
        if size <= 0:
            return n
        u, v = (x[a : a + size], x[b : b + size]) if step > 0 else (x[a - size + 1 : a + 1][::-1], x[b - size + 1 : b + 1][::-1])
        differ = u != v
        k = int(differ.argmax())
        if differ[k]:
            return n + k
        n, a, b, size = n + size, a + step * size, b + step * size, size * 2


class Found:
    """The runs so far, by period, and which stretches they cover."""

    def __init__(self, x: np.ndarray, least: int, times: int):
        self.x, self.least, self.times = x, least, times
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def square(self, start: int, q: int) -> None:
        """Extend the square of root length q at start, unless it lies in a run that is known."""
        known = self.runs[q]
        at = bisect_right(known, (start, len(self.x))) - 1
        if at >= 0 and known[at][1] >= start + 2 * q:
            return
        end = start + 2 * q + _same(self.x, start + 2 * q, start + q, 1)
        start -= _same(self.x, start - 1, start + q - 1, -1)
        if end - start >= max(self.least, self.times * q):
            insort(known, (start, end))


def find_runs(x: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of x, by start, then period. ends: ascending ends of the texts, each at a mark that occurs once in x.

    times must be 4 or more (two periods on one side of a midpoint) and least 6 or more (it then crosses a multiple of 4).
    """
    n, found = len(x), Found(x, least, times)
    half = 4
    top = half
    while top < n:
        top *= 2
    padded = np.concatenate([x, -1 - np.arange(n + 1, n + 1 + (-n) % (2 * top))]) if n else x  # marks that occur once
    half = top
    while half >= 4 and n:  # larger segments first: a run is met first where it crosses the middle
        table = padded.reshape(-1, 2 * half)
        for side, way in ((table[:, half:], 1), (table[:, half - 1 :: -1], -1)):
            block, q = np.nonzero(side[:, 1 : half // 2 + 1] == side[:, :1])
            q += 1
            for probe in (1, 2, 3):  # what else a square of that root needs, cheap parts first
                ok = (q <= probe) | (side[block, np.minimum(probe, q - 1)] == side[block, np.minimum(probe, q - 1) + q])
                block, q = block[ok], q[ok]
            for share in (1, 2, 3):
                at = (q * share) // 4
                ok = side[block, at] == side[block, at + q]
                block, q = block[ok], q[ok]
            ok = side[block, q - 1] == side[block, 2 * q - 1]
            block, q = block[ok], q[ok]
            cut = np.flatnonzero(np.diff(block)) + 1
            for b, largest in zip(block[np.concatenate([[0], cut])] if len(block) else [], np.maximum.reduceat(q, np.concatenate([[0], cut])) if len(block) else [], strict=True):
                m = (2 * int(b) + 1) * half
                for root in roots(side[b, : 2 * int(largest)].tolist()):
                    found.square(m if way > 0 else m - 2 * root, root)
        half //= 2
    return sorted((s, e, q) for q, runs in found.runs.items() for s, e in runs)


Rewrite = Callable[[int | None, int], "np.ndarray | None"]


def runs_of_texts(texts: list[tuple[int | None, str | None]], rewrite: Rewrite | None, least: int, times: int) -> tuple[list[list[Run]], list[bytes]]:
    """For each text its runs (starts and ends as word numbers), and its words without repetitions, joined by blanks."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    words, arrays, ends, at = [], [], [], 0
    for doc_id, text in texts:
        w = (text or "").encode().split()  # the six white-space characters of ASCII
        order = rewrite(doc_id, len(w)) if rewrite and w else None
        if order is not None:
            w = [w[i] for i in order.tolist()]
        words.append(w)
        arrays += [np.fromiter(map(number.__getitem__, w), np.int64, len(w)), np.array([-1 - len(ends)])]
        at += len(w)
        ends.append(at)
        at += 1
    ends = np.array(ends, np.int64)
    x = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    runs: list[list[Run]] = [[] for _ in texts]
    dropped: dict[int, list[slice]] = defaultdict(list)
    for s, e, q in find_runs(x, ends, least, times):
        k = int(np.searchsorted(ends, s))
        first = int(ends[k]) - len(words[k])
        runs[k].append((s - first, e - first, q))
        dropped[k].append(slice(s + q - first, e - first))
    out = []
    for k, w in enumerate(words):
        if k in dropped:
            keep = np.ones(len(w), bool)
            for part in dropped[k]:
                keep[part] = False
            w = [w[i] for i in np.flatnonzero(keep).tolist()]
        out.append(b" ".join(w))
    return runs, out


SCHEMA = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, runs, collapsed) of docs(doc_id, text): every run by start, then period, and the text without the words that a
    run repeats. rewrite(doc_id, number of words) may give the word numbers to read a text by, None for as it is."""
    if times < 4 or least < 6:
        raise ValueError("times must be 4 or more, least 6 or more")

    def parts(batch: pa.RecordBatch) -> Iterator[list[tuple[int | None, str | None]]]:
        held, size = [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            held.append((doc_id, text.as_py()))
            size += len(held[-1][1] or "") // 6
            if size > WORDS:
                yield held
                held, size = [], 0
        if held:
            yield held

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels.enter("periodic")
        for batch in batches:
            for texts in parts(batch):
                runs, collapsed = runs_of_texts(texts, rewrite, least, times)
                flat = [(s, e - s, q) for r in runs for s, e, q in r]
                cols = list(zip(*flat, strict=True)) if flat else [[]] * 3
                struct = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=list(RUN))
                offsets = pa.array(np.cumsum([0] + [len(r) for r in runs]), pa.int32())
                yield pa.record_batch([pa.array([d for d, _ in texts], pa.int64()), pa.ListArray.from_arrays(offsets, struct), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(go, SCHEMA)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """One document in ten gets a periodic tail: the word numbers to read it by."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(read_table(spark, sf_dir, "documents"), planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
