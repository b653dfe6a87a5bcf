"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Words are runs of letters and digits (any byte beyond ASCII counts as a letter) or runs of other visible characters,
A-Z lower-cased; features are words, pairs of neighbouring words and, beside these, two patterns of any words: "a word twice in
a row" and "a word, another, the first again". All are hashed to 2^18 columns.
A document is the mean of its features' columns, so its score is one sparse dot product, whatever its length.

Training takes a bounded sample of labelled rows: the SAMPLE rows of smallest hash of doc_id whose fold is not held out
(crc32 of doc_id as text, mod 4, is not 2). Everything else covers all rows.

Edge cases: null or empty text, or text of white space, scores as the bias alone; a null doc_id is scored, is never
trained on and counts as not held out; labels with null quality are ignored, of a doc_id labelled more than once the
smallest quality counts; repeated rows are scored each; extra columns are kept, one called like the new one is
replaced; very long texts cost their length, and the driver is sent counts of columns only; without any usable label every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import packed, prepare, read_table, unpacked

BITS, SAMPLE, EPOCHS, SCALE, ACCEPT = 18, 6000, 3, 24.0, 0.7
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
U = np.uint64


def features(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, offsets): the hashed features of each document, one for each occurrence."""
    found, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    shift = U(64 - BITS)
    for lo, hi in kernels.parts(offs):
        part, at = b[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        s, e, doc = kernels.runs(part, at, kernels.KIND)
        w = kernels.word_hashes(part, s, e)
        n = np.bincount(doc, minlength=hi - lo) if len(doc) else np.zeros(hi - lo, np.int64)
        pair, twice, again = np.zeros(len(w), U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(w) > 1:
            pair[1:] = kernels.mix(w[:-1] * kernels.MULS[1] + w[1:] * kernels.MULS[2])
            twice = np.flatnonzero((w[1:] == w[:-1]) & (doc[1:] == doc[:-1])) + 1
            again = np.flatnonzero((w[2:] == w[:-2]) & (doc[2:] == doc[:-2])) + 2
        both = np.empty(2 * len(w), np.int32)
        both[0::2] = (w >> shift).astype(np.int32)
        both[1::2] = (pair >> shift).astype(np.int32)
        first = np.cumsum(n) - n
        keep = np.ones(len(both), bool)
        keep[2 * first[n > 0] + 1] = False  # the first word of a document ends no pair
        flags = np.repeat(np.array([kernels.MULS[3] >> shift, kernels.MULS[4] >> shift]).astype(np.int32), [len(twice), len(again)])
        owner = np.concatenate([np.repeat(doc, 2)[keep], doc[twice], doc[again]])
        order = np.argsort(owner, kind="stable")
        found.append(np.concatenate([both[keep], flags])[order])
        sizes.append(np.bincount(owner, minlength=hi - lo))
    return np.concatenate(found), np.cumsum(np.concatenate(sizes))


ENTRY = np.dtype([("column", "<i4"), ("count", "<i4")])


def counted(columns: np.ndarray) -> np.ndarray:
    """ENTRYs of a document's columns: as many as it has different ones, 2^BITS at most, whatever its length."""
    at, n = np.unique(columns, return_counts=True)
    out = np.zeros(len(at), ENTRY)
    out["column"], out["count"] = at, n
    return out


def train(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """(weights, bias) after EPOCHS passes of FTRL-proximal over (ENTRYs, label) rows, in the order given."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        v = z[at]
        return np.where(np.abs(v) <= L1, 0.0, -(v - np.sign(v) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    data = []
    for entries, y in rows:
        at, c = entries["column"], entries["count"]
        data.append((np.append(at, size - 1), np.append(SCALE * c / max(1, c.sum()), 1.0), float(y)))
    for _ in range(EPOCHS):
        for at, x, y in data:
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size))
    return w[:-1].astype(np.float32), float(w[-1])


def fold(doc_id) -> F.Column:
    """Null ids are in no fold."""
    return F.crc32(doc_id.cast("string")) % 4


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Train on at most `sample` labelled rows, held-out fold left out."""
    prepare(docs.sparkSession)
    rows = labels.where("quality is not null and doc_id is not null").where(fold(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.min("quality").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast

    def go(batches):
        kernels.enter("quality")
        for batch in batches:
            b, offs = kernels.texts(batch.column("text"))
            columns, at = features(b, offs)
            packed = [counted(columns[lo:hi]).tobytes() for lo, hi in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(packed, pa.binary())], names=["doc_id", "y", "x"])

    picked = docs.select("doc_id", "text").join(F.broadcast(rows.select("doc_id", F.col("y").cast("int").alias("y"))), "doc_id")
    picked = picked.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))  # bounded, repeated ids too
    got = picked.mapInArrow(go, "doc_id bigint, y int, x binary").toArrow()
    found = [(i, y, x) for i, y, x in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2).to_pylist(), strict=True)]
    found.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % (1 << 64), r[2]))
    model = train([(np.frombuffer(x, ENTRY), y) for _, y, x in found])
    del got, found
    kernels.trim()  # the driver goes on with 1 MB of weights
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """docs with a double column `name`: how likely label 1 is, from the text alone."""
    prepare(docs.sparkSession)
    docs = docs.drop(name) if name in docs.columns else docs
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2^BITS floats: 1 MB

    def go(batches):
        kernels.enter("quality")
        w = shared.value
        for batch in batches:
            b, offs = kernels.texts(batch.column("text"))
            columns, at = features(b, offs)
            n = np.diff(at)
            total = np.concatenate([[0.0], np.cumsum(w[columns], dtype=np.float64)])
            v = bias + SCALE * (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1.0 / (1.0 + np.exp(-np.clip(v, -35, 35))))], names=[*batch.schema.names, name])
        kernels.trim()

    return docs.mapInArrow(go, _plus(docs, name))


def _plus(docs: DataFrame, name: str):
    from pyspark.sql.types import DoubleType, StructField, StructType

    return StructType([*docs.schema.fields, StructField(name, DoubleType())])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return unpacked(score(packed(docs, "text"), model).where(F.col("score") >= ACCEPT), docs.columns)
