"""Suffix-array dedup: a depth-limited radix sort of suffixes, by most-significant-digit passes over their bytes.

Two suffixes that agree in their first WINDOW bytes are a repeated window; a full suffix array would go on ordering them
beyond that, which isn't needed. Of all suffixes only those at anchors are moved: in each window, the GRAM bytes of
smallest hash (the leftmost of equals) are its anchor. The choice depends on the window's bytes alone, so equal windows
have equal anchors at the same place, and one record with the bytes around an anchor stands for all windows it anchors,
about 16.

first digits   Records are dealt by their GRAM bytes and ordered by them, eight bytes a pass. After each pass the groups
               that hold one document leave the sort.
whole records  What is left is ordered by the further bytes, eight a pass. Of records equal in all bytes, those not of
               the smallest document are repeats with all their windows; one stands for the rest.
windows        Records of one group that differ somewhere are ordered a byte a pass, away from the GRAM to either side. A
               window's class is that of its bytes to the left and to the right: equal groups are exactly the repeated
               windows, and all but the smallest document's are repeats.

Bytes decide each step; hashes only choose anchors and deal groups to tasks. Repeats within a block of 8 MB are settled where
they are read, so a text that a third of the documents hold sends one record for each block and anchor. A group is split by its
next digit where it could grow over GROUP bytes: a block that holds more than GROUP's share of one GRAM (GROUP over the
number of blocks) sends one mark for it, and the GRAM's anchors, everywhere, are then dealt by whole windows, each distinct
window once for a block. Buckets are as many as the bytes need, so a task's share doesn't grow with the data. The anchors
are taken in ROUNDS parts by hash, one after the other, so that only a part of the records is on disk at a time.

Edge cases: null or empty text has no bytes and keeps that value; texts under 50 bytes have no window; very long texts are
read in segments; a null doc_id is neither less nor more than others, so such rows stay whole and remove nothing; rows that
share a doc_id don't affect each other, equal rows get equal results; extra columns are kept by dedup_text() and ignored
by the query; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from . import blockshuffle, kernels
from .common import Scratch, packed, read_table, shuffle_partitions, unpacked
from .kernels import MULS, U, mix

WINDOW, GRAM, ROUNDS = 50, 20, 3
LEFT = WINDOW - GRAM  # bytes of a window's anchor record on either side of its GRAM
SPAN = LEFT + 1  # windows that can hold one anchor
CTX = GRAM + 2 * LEFT
BLOCK, SEGMENT = 8 << 20, 1 << 20  # bytes of text that a task holds, and that it hashes, at a time
BUCKET, GROUP = 24 << 20, 64 << 20  # bytes of records that a bucket is meant to hold, and that one GRAM may hold at most
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * MULS[0])
RECORD = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("pos", "<u4"), ("need", "<u4"), ("ctx", "u1", (CTX,))])
WHOLE = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("pos", "<u4"), ("bit", "<u4"), ("body", "u1", (WINDOW,))])
PLACE = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("pos", "<u4"), ("bits", "<u4"), ("crowd", "u1")])
PAIR = np.dtype([("pos", "<u4"), ("bits", "<u4")])
ANSWERS = "doc_id bigint, tag bigint, windows binary, crowd binary"
BITS = np.uint32(1) << np.arange(SPAN, dtype=np.uint32)


def _hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM bytes and of the WINDOW bytes that start at each place."""
    h1 = BYTE[b]
    h2 = h1[:-1] * MULS[1] + h1[1:]
    h4 = h2[:-2] * MULS[2] + h2[2:]
    h8 = h4[:-4] * MULS[3] + h4[4:]
    h16 = h8[:-8] * MULS[4] + h8[8:]
    n = len(b)
    gram = h16[: n - GRAM + 1] * M20 + h4[16 : n - GRAM + 17]
    h32 = h16[:-16] * M32 + h16[16:]
    window = (h32[: n - WINDOW + 1] * M48 + h16[32 : n - WINDOW + 33]) * M50 + h2[48 : n - WINDOW + 49]
    return mix(gram), mix(window)


M20, M32, M48, M50 = (U(int(x) | 1) for x in mix(np.arange(11, 15, dtype=np.uint64)))


def _slide(a: np.ndarray) -> np.ndarray:
    """The least of SPAN (31) neighbouring values, from each place on."""
    for step in (1, 2, 4, 8):
        a = np.minimum(a[:-step], a[step:])
    return np.minimum(a[:-15], a[15:])


def anchors(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, first, last, key, whole) of the anchors of documents laid end to end in b.

    first and last are the windows that the place anchors, key the hash of its GRAM, whole the hash of all its windows.
    """
    n = len(b)
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U), none.astype(U)
    gram, window = _hashes(b)
    least = _slide((gram & ~U(0xFFFFFFFF)) | np.arange(len(gram), dtype=np.uint64))
    at = (least & U(0xFFFFFFFF)).astype(np.int64)
    cuts = offs[1:-1]  # windows over a cut aren't any document's
    over = np.zeros(n + 2, np.int32)
    np.add.at(over, np.maximum(cuts - WINDOW + 1, 0), 1)
    np.add.at(over, cuts, -1)
    good = np.cumsum(over)[: len(at)] == 0
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (good[1:] != good[:-1])]))
    last = np.append(first[1:], len(at)) - 1
    first, last = first[good[first]], last[good[first]]
    place = at[first]
    whole = mix(window[first] * MULS[1] + window[last] * MULS[2] + ((place - first) * 64 + (last - first)).astype(np.uint64) * MULS[3])
    return place, first, last, gram[place], whole


def _segments(offs: np.ndarray):
    """(document range, start, stop) of what is hashed at a time: some documents, or a part of a long one with overlap."""
    for lo, hi in kernels.parts(offs, SEGMENT // 4):
        if offs[hi] - offs[lo] <= SEGMENT:
            yield lo, hi, int(offs[lo]), int(offs[hi])
            continue
        for at in range(int(offs[lo]), int(offs[hi]) - WINDOW + 1, SEGMENT):
            yield lo, hi, at, min(at + SEGMENT + WINDOW - 1, int(offs[hi]))


def _records(b, offs, ids, tags, part):
    """(RECORD, key, whole) arrays of one round's anchors, for about BLOCK bytes of text at a time."""
    held, size = [], 0
    near = np.arange(CTX)
    for lo, hi, start, stop in _segments(offs):
        text = b[start:stop]
        cuts = np.clip(offs[lo : hi + 1], start, stop) - start
        place, first, last, key, whole = anchors(text, cuts)
        turn = key % U(ROUNDS) == U(part)
        place, first, last = place[turn], first[turn], last[turn]
        doc = np.searchsorted(offs, place + start, side="right") - 1
        r = np.zeros(len(place), RECORD)
        r["doc"], r["tag"], r["pos"] = ids[doc], tags[doc], place + start - offs[doc]
        lead = place - first  # windows start lead to place - last bytes before the GRAM
        r["need"] = ((np.uint64(1) << (LEFT + 1 - place + last).astype(np.uint64)) - (np.uint64(1) << (LEFT - lead).astype(np.uint64))).astype(np.uint32)
        wide = np.concatenate([np.zeros(LEFT, np.uint8), text, np.zeros(CTX, np.uint8)])
        ctx = np.lib.stride_tricks.sliding_window_view(wide, CTX)[place]
        inside = (near >= (LEFT - lead)[:, None]) & (near < (LEFT - place + last + WINDOW)[:, None])
        r["ctx"] = np.where(inside, ctx, 0)
        held.append((r, key[turn], whole[turn]))
        size += stop - start
        if size >= BLOCK:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _starts(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, size) of the runs that begin where new is true."""
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before; the first one does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _places(r: np.ndarray, bits: np.ndarray, crowd: int) -> np.ndarray:
    k = np.zeros(len(r), PLACE)
    for c in ("doc", "tag", "pos"):
        k[c] = r[c]
    k["bits"], k["crowd"] = bits, crowd
    return k


def _deal(docs: DataFrame, buckets: int, part: int, share: int) -> DataFrame:
    """Packed records of one round; negative buckets carry places that need no other block to be told."""

    def go(batches):
        kernels.enter("suffix")
        for t in kernels.blocks(batches, "text", BLOCK):
            b, offs = kernels.texts(t.column("text"))
            ids, tags = t.column("doc_id").to_numpy(), t.column("tag").to_numpy().astype(np.uint32)
            for r, key, whole in _records(b, offs, ids, tags, part):
                if not len(r):
                    continue
                both = mix(key ^ (whole * MULS[2]))
                order = np.argsort(both, kind="stable")
                r, key, both = r[order], key[order], both[order]
                new = _changes(both)
                like = np.flatnonzero(~new)
                new[like] = (r["need"][like] != r["need"][like - 1]) | (r["ctx"][like] != r["ctx"][like - 1]).any(axis=1)
                first, size = _starts(new)
                later = r["doc"] > np.repeat(np.minimum.reduceat(r["doc"], first), size)
                told = [_places(r[later], r["need"][later], 0)]
                r, key = r[~later], key[~later]
                order = np.argsort(key, kind="stable")
                first, size = _starts(_changes(key[order]))
                many = size > share
                if many.any():  # the group is split: a mark goes to it, its anchors come back as a crowd's
                    crowd = np.zeros(len(r), bool)
                    crowd[order[np.repeat(many, size)]] = True
                    marks, mark_keys = r[order[first[many]]], key[order[first[many]]]
                    marks["need"] = 0
                    told.append(_places(r[crowd], r["need"][crowd], 1))
                    r, key = np.concatenate([r[~crowd], marks]), np.concatenate([key[~crowd], mark_keys])
                yield from blockshuffle.spread(np.concatenate(told), buckets)
                yield from blockshuffle.pack(mix(key), r, buckets)  # hashes of anchors are small ones: mixed, they spread
                del r, key, both, order, new, like, first, size, later, told, many
                kernels.trim()

    return docs.mapInArrow(go, blockshuffle.SCHEMA)


def _digit(ctx: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Up to eight bytes as one number that orders like them."""
    d = np.zeros((len(ctx), 8), np.uint8)
    d[:, : hi - lo] = ctx[:, lo:hi]
    return d.view(">u8")[:, 0].astype(np.uint64)


def _eights(lo: int, hi: int) -> list[tuple[int, int]]:
    return [(a, min(a + 8, hi)) for a in range(lo, hi, 8)]


def _shared(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, group): rows by their GRAM bytes, of the groups that hold two documents or a mark."""
    alive, group = np.arange(len(r)), np.zeros(len(r), np.int64)
    for lo, hi in _eights(LEFT, LEFT + GRAM):
        d = _digit(r["ctx"][alive], lo, hi)
        order = np.lexsort((d, group)) if group.any() else np.argsort(d, kind="stable")
        alive, group, d = alive[order], group[order], d[order]
        new = _changes(group, d)
        first, size = _starts(new)
        if not len(first):
            break
        doc, need = r["doc"][alive], r["need"][alive]
        stay = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)) | (np.minimum.reduceat(need, first) == 0)
        stay = np.repeat(stay, size)
        alive, group = alive[stay], np.cumsum(new)[stay]
    return alive, group


def _refined(ids: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Classes of classes by one more byte."""
    return np.unique(ids.astype(np.int64) * 256 + byte, return_inverse=True)[1].astype(np.int32)


def _windows(ctx: np.ndarray, need: np.ndarray, doc: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Bits of the windows of each record that a smaller document of its group holds as well."""
    bits = np.zeros(len(ctx), np.uint32)
    right = np.empty((SPAN, len(ctx)), np.int32)
    right[0] = np.unique(group, return_inverse=True)[1]
    for j in range(LEFT):
        right[j + 1] = _refined(right[j], ctx[:, LEFT + GRAM + j])
    left = right[0]
    for j in range(LEFT, -1, -1):
        at = np.flatnonzero(need & BITS[j])
        if len(at) > 1:
            both = (left[at].astype(np.int64) << 32) | right[j][at]
            order = np.argsort(both, kind="stable")
            at, both = at[order], both[order]
            first, size = _starts(_changes(both))
            bits[at[doc[at] > np.repeat(np.minimum.reduceat(doc[at], first), size)]] |= BITS[j]
        if j:
            left = _refined(left, ctx[:, j - 1])
    return bits


def settle(r: np.ndarray) -> np.ndarray:
    """PLACEs of a bucket's RECORDs: windows that are repeats, and (crowd) places whose GRAM's group is split."""
    alive, group = _shared(r)
    if not len(alive):
        return np.zeros(0, PLACE)
    r = r[alive]
    same = np.zeros(len(r), np.int64)
    order = np.lexsort((r["need"], group))
    r, group = r[order], group[order]
    same = np.cumsum(_changes(group, r["need"]))
    for lo, hi in _eights(0, LEFT) + _eights(LEFT + GRAM, CTX):
        d = _digit(r["ctx"], lo, hi)
        order = np.lexsort((d, same))
        r, group, same, d = r[order], group[order], same[order], d[order]
        same = np.cumsum(_changes(same, d))
    first, size = _starts(_changes(same))
    later = r["doc"] > np.repeat(np.minimum.reduceat(r["doc"], first), size)
    later &= r["need"] > 0
    out = [_places(r[later], r["need"][later], 0)]
    r, group, same = r[~later], group[~later], same[~later]
    start, size = _starts(_changes(group))
    split = np.repeat(np.minimum.reduceat(r["need"], start) == 0, size)
    ask = split & (r["need"] > 0)
    out.append(_places(r[ask], r["need"][ask], 1))
    r, group, same = r[~split], group[~split], same[~split]
    if len(r):
        start, size = _starts(_changes(group))
        unlike = np.repeat(same[start] != same[start + size - 1], size)  # groups with more than one kind of record
        r, group, same = r[unlike], group[unlike], same[unlike]
    if len(r):
        first, size = _starts(_changes(same))
        bits = np.repeat(_windows(r["ctx"][first], r["need"][first], r["doc"][first], group[first]), size)
        out.append(_places(r[bits > 0], bits[bits > 0], 0))
    return np.concatenate(out)


def _answers(k: np.ndarray) -> pa.Table:
    """ANSWERS: each document's places, as packed pairs."""
    k = k[np.lexsort((k["crowd"], k["tag"], k["doc"]))]
    first, _ = _starts(_changes(k["doc"], k["tag"]))
    pairs = np.zeros(len(k), PAIR)
    pairs["pos"], pairs["bits"] = k["pos"], k["bits"]
    lists = []
    for kind in (0, 1):
        mine = k["crowd"] == kind
        n = np.add.reduceat(mine.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)]) * PAIR.itemsize
        lists.append(pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(pairs[mine].tobytes())]).cast(pa.binary()))
    return pa.table([pa.array(k["doc"][first].copy()), pa.array(k["tag"][first].astype(np.int64)), *lists], names=["doc_id", "tag", "windows", "crowd"])


def _by_bucket(blocks: DataFrame, buckets: int, dtype: np.dtype, judge) -> DataFrame:
    """ANSWERS of all buckets: judge gives the PLACEs of a bucket's records."""

    def go(t: pa.Table) -> pa.Table:
        if t.num_rows and t.column("bucket")[0].as_py() < 0:
            out = _answers(blockshuffle.unpack(t, PLACE))
        else:
            out = _answers(judge(blockshuffle.unpack(t, dtype)))
        kernels.trim()
        return out

    if buckets > 2 * shuffle_partitions(blocks.sparkSession):
        blocks = blocks.repartition(buckets, "bucket")
    return blocks.groupBy("bucket").applyInArrow(go, ANSWERS)


def _values(cell, dtype=PAIR) -> np.ndarray:
    """All records of a list of binary values, null as none."""
    found = [np.frombuffer(x.as_buffer(), dtype) for x in cell.values if x.is_valid] if cell.is_valid else []
    return np.concatenate(found) if found else np.zeros(0, dtype)


def _deal_windows(rows: DataFrame, buckets: int) -> DataFrame:
    """Packed WHOLE records of the crowds' windows, each distinct one once for some ten thousand; rows(doc_id, tag, text, crowd)."""

    def flush(held):
        r = np.concatenate(held)
        key = _hashes(r["body"].reshape(-1))[1][::WINDOW] if len(r) else np.zeros(0, U)
        order = np.lexsort((r["doc"], key))
        r, key = r[order], key[order]
        new = _changes(key)
        like = np.flatnonzero(~new)
        new[like] = (r["body"][like] != r["body"][like - 1]).any(axis=1)
        first, size = _starts(new)
        later = r["doc"] > np.repeat(r["doc"][first], size)
        yield from blockshuffle.spread(_places(r[later], r["bit"][later], 0), buckets)
        yield from blockshuffle.pack(key[~later], r[~later], buckets)

    def go(batches):
        kernels.enter("suffix")
        held, n = [], 0
        for batch in batches:
            ids, tags = batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist()
            for i in range(batch.num_rows):
                text = np.frombuffer(batch.column("text")[i].as_buffer(), np.uint8)
                crowd = _values(batch.column("crowd")[i])
                for lo in range(0, len(crowd), 4096):
                    some = crowd[lo : lo + 4096]
                    at, j = np.nonzero(some["bits"][:, None] & BITS)
                    r = np.zeros(len(at), WHOLE)
                    r["doc"], r["tag"], r["pos"], r["bit"] = ids[i], tags[i], some["pos"][at], BITS[j]
                    r["body"] = np.lib.stride_tricks.sliding_window_view(text, WINDOW)[some["pos"][at].astype(np.int64) - LEFT + j]
                    held.append(r)
                    n += len(r)
                    if n > 200_000:
                        yield from flush(held)
                        held, n = [], 0
        if held:
            yield from flush(held)

    return rows.mapInArrow(go, blockshuffle.SCHEMA)


def settle_windows(r: np.ndarray) -> np.ndarray:
    """PLACEs of the WHOLE records that a smaller document holds as well; ordered by their bytes, eight a pass."""
    alive, group = np.arange(len(r)), np.zeros(len(r), np.int64)
    for lo, hi in _eights(0, WINDOW):
        d = _digit(r["body"][alive], lo, hi)
        order = np.lexsort((d, group))
        alive, group, d = alive[order], group[order], d[order]
        new = _changes(group, d)
        first, size = _starts(new)
        if not len(first):
            break
        doc = r["doc"][alive]
        stay = np.repeat(np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), size)
        alive, group = alive[stay], np.cumsum(new)[stay]
    r = r[alive]
    first, size = _starts(_changes(group))
    later = r["doc"] > np.repeat(np.minimum.reduceat(r["doc"], first), size) if len(r) else np.zeros(0, bool)
    return _places(r[later], r["bit"][later], 0)


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_tag", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)))


def repeats(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, tag, windows): lists of packed pairs (place, bits of its repeated windows), of documents that repeat anything."""
    rows = _tagged(docs.where("doc_id is not null and octet_length(text) >= 50").select("doc_id", "text")).withColumnRenamed("_tag", "tag")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = 2 * shuffle_partitions(spark)
    buckets = max(least, -(-size * RECORD.itemsize // (16 * ROUNDS * BUCKET)))
    share = max(2, GROUP // (RECORD.itemsize * (least + size // BLOCK)))
    found = []
    for part in range(ROUNDS):
        found.append(scratch.write(_by_bucket(_deal(rows, buckets, part, share), buckets, RECORD, settle), f"pass{part}"))
    lists = lambda *tables: reduce(DataFrame.unionAll, tables).groupBy("doc_id", "tag").agg(F.collect_list("windows").alias("windows"), F.collect_list("crowd").alias("crowd"), F.sum(F.octet_length("crowd")).alias("n"))
    split = lists(*found).where("n > 0").select("doc_id", "tag", "crowd")
    if split.limit(1).count():
        crowds = rows.join(split.hint("shuffle_hash"), ["doc_id", "tag"]).select("doc_id", "tag", "text", "crowd")
        found.append(scratch.write(_by_bucket(_deal_windows(crowds, buckets), buckets, WHOLE, settle_windows), "windows"))
    return lists(*found).select("doc_id", "tag", "windows")


def _removal(size: int, pairs: np.ndarray) -> np.ndarray:
    """Which of size bytes go."""
    d = np.zeros(size + 1, np.int32)
    for lo in range(0, len(pairs), 1 << 16):
        some = pairs[lo : lo + (1 << 16)]
        i, j = np.nonzero(some["bits"][:, None] & BITS)
        s = some["pos"].astype(np.int64)[i] - LEFT + j
        d += np.bincount(s, minlength=size + 1).astype(np.int32) - np.bincount(s + WINDOW, minlength=size + 1).astype(np.int32)
    return np.cumsum(d[:size]) > 0


def dedup(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None, as_text: bool = False) -> DataFrame:
    """docs with `_n_bytes`, `_n_removed`, `_n_spans` and `_kept`, the remaining bytes: binary, or the string of its whole
    characters if as_text; null for null text."""
    scratch = scratch or Scratch(spark, "suffix")
    found = repeats(spark, docs, scratch).select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag2"), F.col("windows").alias("_windows"))
    joined = _tagged(docs).join(found.hint("shuffle_hash"), (F.col("doc_id") == F.col("_doc")) & (F.col("_tag") == F.col("_tag2")), "left").drop("_doc", "_tag", "_tag2")
    names = docs.columns

    def go(batches):
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                batch = big.slice(at, 1024)
                n, removed, spans, kept = [], [], [], []
                for i, text in enumerate(batch.column("text")):
                    buf = text.as_buffer()
                    windows = batch.column("_windows")[i]
                    size = buf.size if buf is not None else 0
                    n.append(size)
                    if not windows.is_valid or not size:
                        removed.append(0)
                        spans.append(0)
                        kept.append(buf.to_pybytes() if buf is not None else None)
                        continue
                    gone = _removal(size, _values(windows))
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    rest = np.frombuffer(buf, np.uint8)[~gone].tobytes()
                    kept.append(rest.decode("utf-8", "ignore").encode() if as_text else rest)
                last = pa.array(kept, pa.binary())
                cols = [batch.column(c) for c in names] + [pa.array(x, pa.int64()) for x in (n, removed, spans)] + [last.cast(pa.string()) if as_text else last]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "_n_bytes", "_n_removed", "_n_spans", "_kept"])
        kernels.trim()

    kind = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in ("_n_bytes", "_n_removed", "_n_spans")), StructField("_kept", StringType() if as_text else BinaryType())])
    return joined.mapInArrow(go, kind)


def dedup_text(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes cut out of `text`, n_chars brought up to date. Bytes of a character that is cut in
    two are dropped as well."""
    whole = dedup(spark, packed(docs, "doc_id", "text"), as_text=True)
    new = {"text": F.col("_kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_kept").cast(docs.schema["n_chars"].dataType)
    return unpacked(whole, docs.columns, **new)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2(F.coalesce("_kept", F.lit(b"")), 256).alias("kept_sha256"))
