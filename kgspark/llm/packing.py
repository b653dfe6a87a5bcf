"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity.

Documents become ids (tokenizers library) plus a separator; longer ones are cut into pieces of the capacity. A bin is
filled greedily with the longest unpacked pieces that fit; then its smallest piece is put back if two unpacked pieces
fill the gap that opens more tightly.

Only lengths matter for that, and there are at most `capacity` of them: the piece lengths are counted (one aggregate of
at most 2048 rows reaches the driver), bins are planned on the counts, equal bins in one step, and pieces are
numbered within their length (a distributed rank, so that no length lands in one task) to look up their place. The plan
is independent of the number of documents: each step uses up a length, or the choices among what is left.

Edge cases: null or empty text is the separator alone; null or repeated doc_ids are packed like others, row by row;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels
from .common import Scratch, read_table

CAPACITY, SEPARATOR, REMEMBER = 2048, 0, 1_000_000
GAPS = re.compile("[ \n]+")
CUT = re.compile("[ \n]+|(?<=[a-zß-öø-ÿ])(?=[,.!?#$%&*|])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """ids of whole texts; the chunks between blanks and line feeds are encoded once and remembered, up to a bound.

    The vocabulary drops white space and splits letters from punctuation before it merges anything, so such chunks are
    independent of each other. Texts without characters beyond U+00FF, of which lower case is one by one and no two
    compose, are lower-cased first, as the vocabulary does, and are also cut between a letter and the marks of CUT.
    Added tokens are matched in the text before any of that: a text that holds one's content, in either case, goes to the
    tokenizer whole and isn't remembered.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocabulary)
        self.known: dict[str, bytes] = {}
        self.added = sorted({t.content.lower() for t in self.tok.get_added_tokens_decoder().values()})

    def learn(self, new: list[str]) -> None:
        plain = [c for c in new if c.isascii() and c.isalpha() and c.islower()]
        tokenize = self.tok.model.tokenize  # no normalizer or splitter has anything to do for these
        self.known.update((c, np.array([t.id for t in tokenize(c)], "<u4").tobytes()) for c in plain)
        rest = [c for c in new if c not in self.known]
        for i in range(0, len(rest), 20_000):
            some = rest[i : i + 20_000]
            self.known.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False), strict=True))

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        low = text.lower()
        if any(t in low for t in self.added):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = CUT.split(low) if text.isascii() or max(text) < "\u0100" else GAPS.split(text)
        known = self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            if len(known) > REMEMBER:
                known.clear()
            self.learn([c for c in dict.fromkeys(chunks) if c not in known])
            return b"".join([known[c] for c in chunks])


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(vocabulary)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document, with the checksum of its ids."""

    def go(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kernels.enter("packing", encoder.cache_clear)
        enc, end = encoder(vocabulary), np.array([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = enc.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(go, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first, times, sequence, offset): of the pieces of that length, those ranked first to
    first + times - 1 go to sequences sequence, sequence + 1, ..., each at offset."""
    left = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        left[k] += v
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    alive = np.flatnonzero(left)
    while len(alive):
        free = left.copy()
        held: list[int] = []
        gap = capacity
        while gap:  # greedy: the longest that fits
            k = int(np.searchsorted(alive, gap, side="right")) - 1
            while k >= 0 and not free[alive[k]]:
                k -= 1
            if k < 0:
                break
            n = int(alive[k])
            m = min(gap // n, int(free[n]))
            held += [n] * m
            free[n] -= m
            gap -= n * m
        small = held[-1]
        pair = None
        if gap and len(held) > 1:  # replace the smallest by two that fill its expanded gap more tightly
            room = gap + small
            a = alive[(free[alive] > 0) & (alive <= room)]
            if len(a):
                at = np.searchsorted(a, room - a, side="right") - 1
                ok = at >= 0
                b = np.where(ok, a[np.maximum(at, 0)], 0)
                same = ok & (b == a) & (free[a] < 2)  # needs another one of that length
                at2 = at - same
                b = np.where(at2 >= 0, a[np.maximum(at2, 0)], 0)
                total = np.where(b > 0, a + b, 0)
                best = int(np.argmax(total))
                if total[best] > small:
                    pair = (int(a[best]), int(b[best]))
        final = held if pair is None else held[:-1] + list(pair)
        need, holds = {}, {}
        for n in final:
            need[n] = need.get(n, 0) + 1
        for n in held + list(pair or ()):
            holds[n] = holds.get(n, 0) + 1
        times = min((int(left[n]) - holds[n]) // m + 1 for n, m in need.items())
        offset, seen = 0, {}
        for n in final:
            rows.append((n, int(used[n]) + seen.get(n, 0) * times, times, sequence, offset))
            seen[n] = seen.get(n, 0) + 1
            offset += n
        for n, m in need.items():
            left[n] -= m * times
            used[n] += m * times
        sequence += times
        alive = alive[left[alive] > 0]
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs(doc_id, text)."""
    scratch = Scratch(spark, "pack")
    rows = scratch.write(pieces(docs, vocabulary or default_vocabulary(), capacity), "pieces")
    # a piece's number within its length: its number within (length, part of the table) plus all parts before
    rows = scratch.write(rows.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "numbered")
    scratch.drop("pieces")
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    table = plan(histogram, capacity)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = spark.sparkContext.broadcast(table)
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1
    ranked = rows.withColumn("rank", within).join(ahead, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("ahead")).alias("rank"))

    def go(batches):
        t = shared.value
        key = t[:, 0] * (1 << 48) + t[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            seq = t[at, 3] + rank - t[at, 1] if len(at) else np.zeros(0, np.int64)
            offset = t[at, 4] if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(go, PIECES + ", sequence_id bigint, offset bigint")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, read_table(spark, sf_dir, "documents"))
