"""The queries of this subpackage, registered by __spark_entry__ when the subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytebpe, embedding_dedup, manifest, merkle, ngram_join, online_packing, packing, periodic, pii, quality, secrets, suffix_dedup, token_counts
from .oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": merkle.op1,
    "op2_pii": pii.op2,
    "op3_best_fit_packing": packing.op3,
    "op4_suffix_array_dedup": suffix_dedup.op4,
    "op5_embedding_near_dedup": embedding_dedup.op5,
    "op6_token_counts": token_counts.op6,
    "op7_byte_bpe": bytebpe.op7,
    "op8_ngram_jaccard_join": ngram_join.op8,
    "op9_secret_scan": secrets.op9,
    "op10_quality_classifier": quality.op10,
    "op11_online_packing": online_packing.op11,
    "op12_merkle_manifest": manifest.op12,
    "op13_periodic_runs": periodic.op13,
}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
