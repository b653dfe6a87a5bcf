"""Bounded-space online packing of tokenized documents into sequences of at most a fixed capacity.

Each partition keeps OPEN windows. A document (ids of the tokenizers library plus an end mark) goes whole to the open
window that it fits best. Where none fits and all windows are open, the fullest one is emitted; a gap of LEAST_PIECE ids or
more is filled first with the document's beginning, so what is padded is less than LEAST_PIECE a sequence. A document of
more than the capacity fills sequences of its own, and only its rest is placed.

What a partition's windows hold at its end are leftovers, at most OPEN windows whatever its size. They travel with their
ids, are merged by the same rule for FANIN partitions at a time, round after round, and the last merge cuts them to whole
sequences; the rest, less than one sequence in the whole corpus, is cut to powers of two, which need no padding. No
other row is shuffled, and no task sees more than FANIN * OPEN windows of leftovers. Partitions are read and packed in their
order, so a lost task gives the same pieces again.

Edge cases: null or empty text is the end mark alone; null or repeated doc_ids are packed like others, row by row; a text of
any length only costs its length; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import Scratch, read_table

CAPACITY, END, OPEN, LEAST_PIECE, FANIN, REMEMBER = 2048, 1, 32, 4, 64, 500_000

# Character classes up to U+024F as Unicode has them: white space, letters, numbers.
_W, _L, _N = "\t-\r \x85\xa0", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The tokenizer's own split of texts without characters beyond U+024F.
SPLIT = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
BEYOND = re.compile("[^\x00-ɏ]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """ids of whole texts; what the tokenizer's own split gives is encoded once and remembered, up to a bound.

    That split is only repeated here where the characters' classes are certain (up to U+024F). Other texts, and those that hold an
    added token, which is matched before any split, go to the tokenizer whole.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocabulary)
        self.known: dict[str, bytes] = {}
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            self.known.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False), strict=True))

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not text.isascii() and BEYOND.search(text) or any(t in text for t in self.added):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks, known = SPLIT.findall(text), self.known
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


#: (doc_id, start, ids, doc_tokens)
Piece = tuple[int | None, int, bytes, int]


class Windows:
    """A fixed number of open windows; finished sequences go to emit, as lists of pieces."""

    def __init__(self, emit: Callable[[list[Piece]], None], capacity: int = CAPACITY, most: int = OPEN, least: int = LEAST_PIECE):
        self.emit, self.capacity, self.most, self.least = emit, capacity, most, least
        self.gaps: list[int] = []
        self.held: list[list[Piece]] = []

    def place(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int) -> None:
        capacity = self.capacity
        while len(ids) >= 4 * capacity:
            self.emit([(doc_id, start, ids[: 4 * capacity], doc_tokens)])
            ids, start = ids[4 * capacity :], start + capacity
        while ids:
            n = len(ids) // 4
            fitting = [g for g in self.gaps if g >= n]
            if fitting:
                at = self.gaps.index(min(fitting))
            elif len(self.gaps) < self.most:
                at = len(self.gaps)
                self.gaps.append(capacity)
                self.held.append([])
            else:
                gap = min(self.gaps)
                at = self.gaps.index(gap)
                if gap < self.least:
                    self.close(at)
                    continue
                n = gap
            self.held[at].append((doc_id, start, ids[: 4 * n], doc_tokens))
            self.gaps[at] -= n
            if not self.gaps[at]:
                self.close(at)
            ids, start = ids[4 * n :], start + n

    def close(self, at: int) -> None:
        self.emit(self.held.pop(at))
        self.gaps.pop(at)

    def finish(self) -> None:
        """Emit what is open: cut to whole sequences from the fullest window on, the rest to powers of two."""
        rest = sum(self.capacity - g for g in self.gaps)
        sizes = [self.capacity] * (rest // self.capacity) + [1 << k for k in reversed(range(self.capacity.bit_length())) if rest % self.capacity >> k & 1]
        pieces = [p for _, held in sorted(zip(self.gaps, self.held, strict=True), key=lambda x: x[0]) for p in held][::-1]
        for size in sizes:
            sequence = []
            while size:
                doc_id, start, ids, total = pieces.pop()
                n = min(size, len(ids) // 4)
                sequence.append((doc_id, start, ids[: 4 * n], total))
                if len(ids) > 4 * n:
                    pieces.append((doc_id, start + n, ids[4 * n :], total))
                size -= n
            self.emit(sequence)
        self.gaps, self.held = [], []


KINDS = {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
#: ids only of leftovers: in place of a sequence they have the number of their window
SCHEMA = ", ".join(f"{k} {v}" for k, v in KINDS.items()) + ", ids binary, part int"
ARROW = pa.schema([(k, pa.int64()) for k in KINDS] + [("ids", pa.binary()), ("part", pa.int32())])


class Rows:
    """Rows of emitted sequences and of windows that stay open."""

    def __init__(self, level: int, part: int):
        self.rows: list[tuple] = []
        self.part, self.sequence = part, (level << 58) | (part << 34)

    def add(self, pieces: list[Piece], left: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.sequence, offset, ids if left else None, self.part))
            offset += n
        self.sequence += 1

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(ARROW)
        self.rows = []
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, ARROW, strict=True)], schema=ARROW)


def _first(vocabulary: str, capacity: int, most: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kernels.enter("online_packing", encoder.cache_clear)
        enc, end = encoder(vocabulary), np.array([END], "<u4").tobytes()
        out = Rows(0, TaskContext.get().partitionId())
        windows = Windows(out.add, capacity, most)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = enc.ids(text.as_py() or "") + end
                windows.place(doc_id, 0, ids, len(ids) // 4)
            yield out.take()
        for held in windows.held:
            out.add(held, left=True)
        yield out.take()

    return go


def _merge(level: int, last: bool, capacity: int, most: int):
    def go(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        out = Rows(level, table.column("group")[0].as_py())
        windows = Windows(out.add, capacity, most)
        for p in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            windows.place(*p)
        if last:
            windows.finish()
        for held in windows.held:
            out.add(held, left=True)
        return pa.Table.from_batches([out.take()])

    return go


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, most: int = OPEN, fanin: int = FANIN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs(doc_id, text)."""
    scratch = Scratch(spark, "online-pack")
    rows = scratch.write(docs.select("doc_id", "text").mapInArrow(_first(vocabulary or default_vocabulary(), capacity, most), SCHEMA), "pieces0")
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1  # at least the one that holds the leftovers of all
    done, level = [rows.where("ids is null").select(*KINDS)], 0
    while True:
        level += 1
        parts = -(-parts // fanin)
        left = rows.where("ids is not null").withColumn("group", F.floor(F.col("part") / fanin).cast("int"))
        rows = scratch.write(left.groupBy("group").applyInArrow(_merge(level, parts == 1, capacity, most), SCHEMA), f"pieces{level}")
        done.append(rows.where("ids is null").select(*KINDS))
        if parts == 1:
            return functools.reduce(DataFrame.union, done)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, read_table(spark, sf_dir, "documents"))
