"""Byte-level BPE encoding and decoding over Arrow batches with the tokenizers library.

A rank file (base64 token, rank) becomes a tokenizers model: each byte is written as one printable character, each
token as the characters of its bytes, and the merges are recovered from the ranks, a token's merge being the two
tokens that its own bytes come down to with the ranks before it. Texts are split by the pattern; every match is encoded
separately, one that is a token itself as that token. Matches are encoded once per task and remembered, up to a bound.

Decoding looks each id up in the byte table and joins the bytes; characters that a token boundary splits come together
again because bytes are joined before anything is read as UTF-8. What is then no UTF-8 stays as bytes.

Edge cases: null or empty text has no ids and decodes to nothing; a null list of ids decodes to no bytes; a null id in a list, or one
outside the table, is skipped; nothing depends on doc_id, so null or repeated ones and repeated rows pass through, as
do extra columns (one called like a new column is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from . import kernels
from .common import prepare, read_table

REMEMBER = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else one from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merge to token when only lower ranks are used."""
    parts, most = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best, at = most, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], most)
            if r < best:
                best, at = r, i
        if at < 0:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        chars = byte_characters()
        spell = {t: "".join(chars[x] for x in t) for t in ranks}
        merges = [m for m in (merge_of(t, ranks) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1) if m]
        model = models.BPE(vocab={spell[t]: r for t, r in ranks.items()}, merges=[(spell[a], spell[b]) for a, b in merges], ignore_merges=True)
        self.tok = Tokenizer(model)
        self.tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern, self.known = regex.compile(pattern), {}

    def spans(self, text: str) -> list[str]:
        """The pattern's matches, each of them known from now on."""
        found, known = self.pattern.findall(text), self.known
        new = [w for w in dict.fromkeys(found) if w not in known]
        if new:
            if len(known) > REMEMBER:
                known.clear()
                new = list(dict.fromkeys(found))
            for i in range(0, len(new), 20_000):
                some = new[i : i + 20_000]
                known.update(zip(some, (e.ids for e in self.tok.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        return found

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for w in self.spans(text):
            out += known[w]
        return out

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """(start, end) in characters of each id; an id that holds part of a character spans that whole character."""
        out, ids = [], self.ids(text)
        starts = np.cumsum([0] + [len(c.encode()) for c in text])  # byte offset of each character
        covered = [(m.start(), m.end()) for m in self.pattern.finditer(text)]
        k = 0
        for lo, hi in covered:
            at = int(starts[lo])
            while at < starts[hi]:
                to = at + len(self.bytes_of[ids[k]])
                out.append((int(np.searchsorted(starts, at, side="right")) - 1, int(np.searchsorted(starts, to, side="left"))))
                at, k = to, k + 1
        return out


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBPE:
    """One for all tasks of a Python worker."""
    return ByteBPE(path, pattern)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _schema(df: DataFrame, *new: StructField) -> StructType:
    return StructType([*df.schema.fields, *new])


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """docs with `ids` (array of int), and with `starts` and `ends` (characters) if offsets are asked for."""
    prepare(docs.sparkSession)
    path, pattern = path or default_vocabulary(), pattern or _pattern()
    new = ["ids", "starts", "ends"] if offsets else ["ids"]
    docs = docs.drop(*new)

    def go(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kernels.enter("bytebpe", coder.cache_clear)
        bpe = coder(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = [np.array(bpe.ids(t), np.int32) for t in texts]
                ends = np.cumsum([0] + [len(x) for x in ids], dtype=np.int32)
                cols = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else [], pa.int32()))]
                if offsets:
                    spans = [bpe.offsets(t) for t in texts]
                    cols += [pa.array([[s[i] for s in x] for x in spans], pa.list_(pa.int32())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *new])

    return docs.mapInArrow(go, _schema(docs, *(StructField(n, ArrayType(IntegerType())) for n in new)))


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """tokens(ids, ...) with `decoded`, the bytes that the ids stand for; cast it to string to read it as UTF-8."""
    prepare(tokens.sparkSession)
    path = path or default_vocabulary()
    tokens = tokens.drop("decoded")

    def go(batches):
        ranks = read_ranks(path)
        most = max(ranks.values()) + 1
        table = [b""] * (most + 1)
        for t, r in ranks.items():
            table[r] = t
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out = []
                for ids in batch.column("ids"):
                    v = ids.values
                    if v is None:
                        out.append(b"")
                        continue
                    x = v.fill_null(most).to_numpy(zero_copy_only=False)
                    out.append(b"".join([table[i] if 0 <= i < most else b"" for i in x.tolist()]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(go, _schema(tokens, StructField("decoded", BinaryType())))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    hashed = ids.withColumn("ids_sha256", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)).withColumn("n_tokens", F.size("ids").cast("long"))
    return decode(hashed).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
